"""Choices that change how records are read; the defaults give the current behaviour."""

from __future__ import annotations

from dataclasses import dataclass

CHOICES = {
    "es_text": ("parse", "minimal"),
    "json_rules": ("generic", "ecs", "es_json"),
    "levels": ("verbatim", "titled"),
    "arguments": ("clean", "full", "leftovers"),
}


@dataclass(frozen=True)
class Options:
    """How to normalise.

    es_text: parse search-engine text lines, or leave them to the minimal rules.
    json_rules: rules for JSON objects that are not canonical.
    levels: keep a JSON level as written, or honour ``l`` and title-case.
    arguments: de-duplicated leftovers, full nested objects, or bare leftovers.
    prefixed_json: also read JSON that starts after some text.
    day_first: how ``03.04.2025`` in a JSON time key reads.
    preserve_standard: keep input ``l``, ``args``, ``ex``, ``trace_id`` and ``transaction_id`` of
        non-canonical JSON as ``original_*`` arguments instead of losing them.
    keep_other_times: keep time-named arguments that show another time than the record's; nested ones stay.
    keep_two_bracket_message: keep the message of procrun lines that have no third bracket.
    fallback_time: canonical time text for lines without a time; the run's time when None.
    """

    es_text: str = "parse"
    json_rules: str = "generic"
    levels: str = "verbatim"
    arguments: str = "clean"
    prefixed_json: bool = False
    day_first: bool = True
    preserve_standard: bool = False
    keep_other_times: bool = False
    keep_two_bracket_message: bool = False
    fallback_time: str | None = None

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")


DEFAULT = Options()
