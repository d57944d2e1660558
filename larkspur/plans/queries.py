"""All named queries of the library over the test tables."""

from larkspur.plans import conversation, extras, graph, intake, qa, records, relational, retrieval, review, risk, streaming, temporal, text  # noqa: F401  (they register)
from larkspur.plans.registry import ORACLES, QUERIES  # noqa: F401
