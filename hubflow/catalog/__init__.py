"""Registered queries, each with the SQL that checks it."""

from hubflow.catalog.domain import DOMAIN
from hubflow.catalog.primitives import PRIMITIVES
from hubflow.catalog.reports import REPORTS

CHECKS = {**REPORTS, **DOMAIN, **PRIMITIVES}
