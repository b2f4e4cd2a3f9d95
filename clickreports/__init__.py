"""Clickstream funnel, conversion and revenue reports on Spark DataFrames."""

from clickreports.plans.catalog import BY_SOURCE, OVERALL, report
from clickreports.plans.marts import Marts
from clickreports.sources.events import load_events, register

__all__ = ["BY_SOURCE", "OVERALL", "Marts", "load_events", "register", "report"]
