"""Wiring of the operators to the driver tables, one registered query per operator."""

from importlib import import_module

SECTIONS = ["q_text", "q_retrieve", "q_fuse", "q_agree", "q_rounds", "q_sampling", "q_json", "q_sources"]


def load_all() -> None:
    for name in SECTIONS:
        import_module(f"evirank.plans.{name}")
