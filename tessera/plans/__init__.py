"""Named queries; importing the package registers all of them in catalog.QUERIES."""

from . import catalog, cases, graphs, more  # noqa: F401  isort: skip
