"""Conformance checks of a provider and of a set-up, before a long run."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import prompts, responses
from ..operators.labelling import merge_labels
from ..operators.providers import OfflineProvider, Provider, style_of

TEXTS = ["wake me up at seven", "play some quiet music", "what is the weather in the valley", "add bread to the shopping list", "turn off the kitchen lights"]
LABELS = ["alarm", "music", "weather", "shopping list", "lights"]


def probe(factory: Callable[[], Provider] = OfflineProvider, consistency: int = 3) -> dict[str, bool]:
    """reachable, JSON shape of labels and of a merge, merging shrinks, a valid label, the same label each time, no reasoning tokens."""
    p = factory()
    reasoning = 0

    def chat(prompt: str, max_tokens: int | None = None) -> str | None:
        nonlocal reasoning
        said = p.chat(prompt, max_tokens)
        reasoning += getattr(p, "last", (0, 0, 0))[2]
        return said

    labels = responses.parse_labels(chat(prompts.generate_labels(TEXTS)))
    doubled = LABELS * 2 + ["alarms", "songs"]
    json_merge = bool(responses.parse_merged(chat(prompts.merge_labels(doubled, len(LABELS)))))
    merged = merge_labels(doubled, p, len(LABELS))
    answers = [responses.single_answer(chat(prompts.classify("play a song with quiet music", LABELS)), LABELS) for _ in range(consistency)]
    return {
        "reachable": chat(prompts.classify(TEXTS[0], LABELS)) is not None,
        "json_labels": bool(labels),
        "json_merge": json_merge,
        "merge_shrinks": json_merge and 0 < len(merged) < len(doubled),
        "valid_label": answers[0] in LABELS,
        "consistent": len(set(answers)) == 1,
        "within_tokens": chat(prompts.classify(TEXTS[1], LABELS), max_tokens=64) is not None and reasoning == 0,
    }


def verdict(found: dict[str, bool]) -> str:
    """``unusable`` without reach or JSON, ``good`` if all hold, else ``usable``."""
    if not (found["reachable"] and found["json_labels"]):
        return "unusable"
    return "good" if all(found.values()) else "usable"


def preflight(settings, spark, data_root: str, datasets: list[str], factory: Callable[[], Provider] = OfflineProvider, key: str = "", seeds: str = "") -> dict[str, object]:
    """Settings file, key, sound settings (and their echo), data, provider checks, seed labels: is everything there that a run needs?

    ``key`` and ``seed_labels`` are only asked of runs that need them: an endpoint, and a path of seed labels.
    """
    import json
    import os
    from dataclasses import asdict

    from ..sources import readers
    from .cache import exists

    there = readers.find_datasets(spark, data_root)
    sound = settings.k_min <= settings.k_max and settings.label_chunk > 0 and settings.classify_batch > 0
    chosen = json.loads(spark.read.text(seeds, wholetext=True).first()[0]) if seeds and exists(spark, seeds) else []
    return {
        "settings_file": os.path.exists(".env"), "key": bool(key) or style_of(settings) == "offline", "settings": sound,
        "data": all(d in there for d in datasets), **probe(factory, 2), "seed_labels": bool(chosen) or not seeds,
        "echo": asdict(settings) | {"style": style_of(settings)},
    }
