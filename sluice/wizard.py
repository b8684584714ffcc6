"""A conversation that makes a source: a URL, what is found there, which fields, how many pages, how often."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import Any

from sluice.plans.config import ConfigError, ExtractionConfig
from sluice.plans.propose import propose
from sluice.plans.schedule import PRESETS, valid

Ask = Callable[[str], str]


def asked(ask: Ask, say: Callable[[str], None], question: str, read: Callable[[str], Any], tries: int = 3) -> Any:
    """The answer as ``read`` takes it; a ValueError asks again, three times in all."""
    for _ in range(tries):
        try:
            return read(ask(question).strip())
        except ValueError as e:
            say(str(e))
    raise ConfigError(f"no answer to: {question}")


def picked(names: list[str]) -> Callable[[str], list[str]]:
    def read(text: str) -> list[str]:
        out = [w.strip() for w in text.split(",") if w.strip()] or names
        if unknown := [w for w in out if w not in names]:
            raise ValueError(f"no field {', '.join(unknown)}; there are {', '.join(names)}")
        return out

    return read


def number(default: int) -> Callable[[str], int]:
    def read(text: str) -> int:
        n = int(text or default)
        if n < 1:
            raise ValueError("at least 1")
        return n

    return read


def times(text: str) -> str | None:
    if text in ("", "none"):
        return None
    if not valid(text):
        raise ValueError(f"not a cron expression or one of {', '.join(PRESETS)}: {text}")
    return PRESETS.get(text, text)


def converse(url: str, analysis: Mapping[str, Any], ask: Ask, say: Callable[[str], None]) -> ExtractionConfig:
    """From a page's analysis, with the user's answers, to a config."""
    blocks, fields = analysis["blocks"], analysis["fields"]
    if not blocks:
        raise ConfigError(f"{url} has no repeated items")
    say(f"{analysis['page_type']} page, {blocks[0]['count']} items of {blocks[0]['selector']}")
    for f in fields:
        say(f"  {f['name']}: {f['inferred_type']}, {f['confidence']:.2f}, e.g. {', '.join(f['sample_values'][:2])}")
    names = [f["name"] for f in fields]
    chosen = asked(ask, say, f"Fields, with commas [{','.join(names)}]: ", picked(names))
    name = ask(f"Name [{analysis['title']}]: ").strip() or analysis["title"]
    pages = asked(ask, say, "Pages to read at most [10]: ", number(10)) if analysis["pagination"] else 1
    schedule = asked(ask, say, f"How often ({', '.join(PRESETS)}, cron, none) [none]: ", times)
    return replace(propose(name, url, analysis, chosen, pages), schedule=schedule)
