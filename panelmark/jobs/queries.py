"""All registered queries of the label-audit operators and their comparison SQL."""

from panelmark.jobs import io_registry, md5_registry, registry  # noqa: F401  each registers its own

QUERIES, SQL = registry.QUERIES, registry.SQL
