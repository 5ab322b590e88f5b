"""All registered queries of the library itself."""

from sparkloom.plans import evaluation, learning, relational, texts  # noqa: F401
from sparkloom.plans.registry import QUERIES, SQL  # noqa: F401
