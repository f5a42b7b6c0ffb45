"""Named queries; importing the package fills the registry."""

from sparkloom.plans import analytics, documents, frameworks, lookups, markup, pages, relations, reports, rules, scalars, specs  # noqa: F401
