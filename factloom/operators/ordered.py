"""Operators whose outcome depends on what was chosen before: greedy merges, top-k with suppression, windows with overlap.

Each works on one key at a time (a subject, a chapter, a video) through applyInPandas; keys are blocks that the caller
makes small enough, and Spark deals and shuffles them. Inside a block there is no way around the order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame


def squeezed(text: str | None) -> str:
    """The text without white space."""
    return "".join((text or "").split())


def first_alike(texts: Iterable[str], text: str, least: float) -> int | None:
    """Place of the first of the squeezed texts that the squeezed text is like: equal, contained, or of a gestalt ratio of at least `least`.

    The ratio is worked out only where its two upper bounds, the lengths and the letters in common, allow it; what the matcher
    holds of the text is made once.
    """
    if not text:
        return None
    matcher = None
    for i, other in enumerate(texts):
        if not other:
            continue
        if other in text or text in other:
            return i
        if 2 * min(len(other), len(text)) / (len(other) + len(text)) < least:
            continue
        if matcher is None:
            matcher = SequenceMatcher(a="", b=text)
        matcher.set_seq1(other)
        if matcher.quick_ratio() >= least and matcher.ratio() >= least:
            return i
    return None


def alike(a: str, b: str, least: float) -> bool:
    """Equal, contained, or of a gestalt ratio of at least `least`, white space ignored."""
    return first_alike([squeezed(a)], squeezed(b), least) is not None


def merge_near(units: DataFrame, keys: Sequence[str], uid: str, statement: str, least: float = 0.84) -> DataFrame:
    """(keys, uid, kept_uid): first-fit merge in order of uid; each unit joins the first kept one that it is like."""
    names = [*keys, uid]

    def fold(block: pd.DataFrame) -> pd.DataFrame:
        kept, texts, equal, out = [], [], {}, []
        for row in block.sort_values(uid).itertuples(index=False):
            text = squeezed(getattr(row, statement))
            # an equal text before it went through the same kept ones, and joined or became one of them
            at = equal.get(text) if text else None
            at = first_alike(texts, text, least) if at is None else at
            if at is None:
                at = len(kept)
                kept.append(getattr(row, uid))
                texts.append(text)
            equal[text] = at
            out.append([*(getattr(row, k) for k in names), kept[at]])
        return pd.DataFrame(out, columns=[*names, "kept_uid"])

    types = dict(units.dtypes)
    return units.select(*names, statement).groupBy(*keys).applyInPandas(fold, ", ".join(f"{n} {types[n]}" for n in names) + f", kept_uid {types[uid]}")


def select_distinct_top(units: DataFrame, keys: Sequence[str], uid: str, statement: str, priority: Sequence[str], limit: int, least: float = 0.82) -> DataFrame:
    """(keys, uid, rank): per key the best units by descending priority (ties by uid), leaving out what is like a chosen one."""
    names = [*keys, uid]

    def choose(block: pd.DataFrame) -> pd.DataFrame:
        ordered = block.sort_values([*priority, uid], ascending=[False] * len(priority) + [True])
        chosen, out = [], []
        for row in ordered.itertuples(index=False):
            text = squeezed(getattr(row, statement))
            if text and any(first_alike([text], t, least) is not None for t in chosen):
                continue
            chosen.append(text)
            out.append([*(getattr(row, k) for k in names), len(chosen)])
            if len(chosen) == limit:
                break
        return pd.DataFrame(out, columns=[*names, "rank"])

    types = dict(units.dtypes)
    return units.select(*names, statement, *[p for p in priority if p not in names]).groupBy(*keys).applyInPandas(choose, ", ".join(f"{n} {types[n]}" for n in names) + ", rank int")


def temporal_windows(segments: DataFrame, key: str, order: str, start: str, end: str, text: str, target: int = 90_000, longest: int = 150_000, overlap: int = 8_000, markers: Sequence[str] = ()) -> DataFrame:
    """(key, window, first, last, start_ms, end_ms): windows that split at `longest`, at a marker past `target`, or at 1.35 targets.

    A window begins with the tail of the one before that lasts at least `overlap`.
    """

    def cut(block: pd.DataFrame) -> pd.DataFrame:
        rows = [(getattr(r, order), getattr(r, start), getattr(r, end), "".join((getattr(r, text) or "").split())) for r in block.sort_values(order).itertuples(index=False)]
        held, out = [], []
        for row in (r for r in rows if r[3]):
            lasts = row[2] - held[0][1] if held else 0
            if held and (lasts >= longest or lasts >= target and any(m in row[3] for m in markers) or lasts >= 1.35 * target):
                out.append((held[0][0], held[-1][0], held[0][1], held[-1][2]))
                tail = len(held) - 1
                while overlap > 0 and tail > 0 and held[-1][2] - held[tail][1] < overlap:
                    tail -= 1
                held = held[tail:] if overlap > 0 else []
            held.append(row)
        if held:
            out.append((held[0][0], held[-1][0], held[0][1], held[-1][2]))
        made = pd.DataFrame(out, columns=["first_index", "last_index", "start_ms", "end_ms"])
        made.insert(0, "window", range(len(made)))
        made.insert(0, key, block[key].iloc[0])
        return made

    kinds = dict(segments.dtypes)
    schema = f"{key} {kinds[key]}, window int, first_index {kinds[order]}, last_index {kinds[order]}, start_ms long, end_ms long"
    return segments.select(key, order, start, end, text).groupBy(key).applyInPandas(cut, schema)
