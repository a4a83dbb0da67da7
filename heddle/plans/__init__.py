"""The queries over the driver's tables, by area; importing a module registers its queries."""

from heddle.plans import captured, changes, companies, connected, control, found, listings, observations, packages, profiles, registers, rules, samples, scores, screens, stated, streams, texts, values  # noqa: F401
