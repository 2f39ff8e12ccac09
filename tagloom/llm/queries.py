"""Loads every operator's queries. Tasks import single operators, so the package itself imports nothing."""

from tagloom.llm import bpe, chat, decontaminate, host_rules, licenses, minhash, repeats, rule_ensemble, secrets, spelling, toxicity, warc, whitening  # noqa: F401
from tagloom.llm.registry import ORACLES, QUERIES  # noqa: F401
