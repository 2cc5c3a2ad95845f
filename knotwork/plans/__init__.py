"""Queries over the test tables, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

from knotwork.plans.registry import Registry

MODULES = ("wide", "blocking", "judgements", "statements", "matching", "training", "enrich", "streaming")


def core_registries() -> list[Registry]:
    return [importlib.import_module(f"knotwork.plans.{name}").REGISTRY for name in MODULES]
