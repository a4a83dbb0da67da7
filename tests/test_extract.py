"""Counts of people in reports: each wording, lines on groups, conflicts."""

from __future__ import annotations

import pytest

from heddle.operators import extract


@pytest.mark.parametrize(
    ("text", "value", "measure", "status"),
    [
        ("Antall årsverk i regnskapsaret er 12", 12, "full_time_equivalents", "accepted"),
        ("Tal på årsverk i rekneskapsaret: 3,5", 3.5, "full_time_equivalents", "accepted"),
        ("tal på årsverk: 3", None, None, "no_employee_phrase"),
        ("Antall aarsverk sysselsatt i regnskapsaret 1O", 10, "full_time_equivalents", "accepted"),
        ("ANTALL ÅRSVERK SYSSETSATT I REGNSKAPSARET = 1.234", 1234, "full_time_equivalents", "accepted"),
        ("antall årsverk:7", 7, "full_time_equivalents", "accepted"),
        ("Selskapet har i 2023 sysselsatt 4 årsverk", 4, "full_time_equivalents", "accepted"),
        ("Selskapet har sysselsatt 4 arsverk", 4, "full_time_equivalents", "accepted"),
        ("Selskapet har 4 årsverk", 4, "full_time_equivalents", "accepted"),
        ("Gjennomsnittlig antall ansatte i regnskapsaret er 9", 9, "employees", "accepted"),
        ("gjennomsnittlige antall ansatte 9", 9, "employees", "accepted"),
        ("antall ansatte er 2\n5 ansatte", 2, "employees", "accepted"),
        ("Vi er 5 heltidsansatte.", 5, "employees", "accepted"),
        ("Det er tre ansatte i selskapet", 3, "employees", "accepted"),
        ("Selskapet har ingen ansatte", 0, "employees", "accepted"),
        ("Stiftelsen har ikke hatt noen ansatte", 0, "employees", "accepted"),
        ("Legatet hadde ingen ansatte", 0, "employees", "accepted"),
        ("Selskapet har ingen årsverk", 0, "full_time_equivalents", "accepted"),
        ("antall ansatte 5\nantall ansatte 6", None, None, "conflicting_employee_counts"),
        ("antall årsverk 5\nSelskapet har ingen ansatte", None, None, "conflicting_employee_counts"),
        ("antall årsverk 0\nSelskapet har ingen ansatte", 0, "full_time_equivalents", "accepted"),
        ("Konsernet: antall ansatte 50\nantall ansatte 5", 5, "employees", "accepted"),
        ("antall ansatte 900000", None, None, "no_employee_phrase"),
        ("det er ingen her", None, None, "no_employee_phrase"),
        (None, None, None, "no_employee_phrase"),
        ("", None, None, "no_employee_phrase"),
    ],
)
def test_people_are_counted(spark, text, value, measure, status):
    got = extract.workforce(spark.createDataFrame([(text,)], "t string"), "t").head()
    assert (got.value, got.measure, got.status) == (value, measure, status)
