"""The extraction hook: what a model would say about each unit, from an injected callable or a rule-based stand-in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from rostrum.schema import table_schema

BODY = 60_000
NOTES = {"summary": 600, "evidence_note": 400}
#: The allowed stances and argument types.
STANCES = ("support", "oppose", "mixed", "neutral")
ARGUMENTS = ("statutory_authority", "apa_procedure", "technical", "scientific", "economic_cost", "feasibility", "small_business", "equity", "privacy", "security", "definitional", "none")
_HINTS = {"economic_cost": r"\bcosts?\b|\$", "statutory_authority": r"statut|authority", "small_business": r"\bsmall\b", "technical": r"\bsection\b|standard", "scientific": r"stud(?:y|ies)|survey|measured"}

Model = Callable[[str], dict | None]


def rules(text: str) -> dict:
    """A deterministic stand-in of the same shape as a model's answer."""
    low = text.lower()
    oppose, support = (len(re.findall(p, low)) for p in (r"oppose|withdraw|reject|drop", r"support|adopt|strengthen"))
    stance = "neutral" if oppose == support == 0 else "oppose" if oppose > support else "support" if support > oppose else "mixed"
    words = len(low.split())
    return {
        "stance": stance, "argument_types": [k for k, p in _HINTS.items() if re.search(p, low)] or ["none"], "provisions": re.findall(r"\d{1,3}\.\d{1,3}(?:\([a-z0-9]{1,4}\))*", text)[:8],
        "requested": ["modify_text"] if "request" in low else ["no_change"], "novel_evidence": bool(re.search(_HINTS["scientific"], low)), "evidence_note": "",
        "significance": min(100, words // 2), "summary": text[:120],
    }


def extract(units: DataFrame, model: Model = rules, name: str = "rules") -> DataFrame:
    """The analysis table for (comment_id, full_text): a unit whose answer is missing or malformed is skipped."""
    shape = table_schema("analysis")
    columns = shape.fieldNames()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for comment_id, text in zip(frame["comment_id"], frame["full_text"], strict=True):
                try:
                    answer = model((text or "")[:BODY])
                except Exception:  # one unit's failure leaves the others
                    continue
                if not isinstance(answer, dict) or answer.get("stance") not in STANCES:
                    continue
                lists = {k: [str(x) for x in answer.get(k) or []] for k in ("argument_types", "provisions", "requested")}
                lists["argument_types"] = [x for x in lists["argument_types"] if x in ARGUMENTS]
                notes = {k: str(answer.get(k) or "")[:n] for k, n in NOTES.items()}
                number = answer.get("significance")
                significance = max(0, min(100, int(number))) if isinstance(number, int | float) else None
                out.append({"comment_id": comment_id, "stance": answer["stance"], **lists, **notes, "novel_evidence": bool(answer.get("novel_evidence")), "significance": significance, "model": name, "tokens_in": len(text or "") // 4, "tokens_out": 200})
            yield pd.DataFrame(out, columns=columns)

    return units.select("comment_id", "full_text").mapInPandas(run, shape)


def adjudicate(candidates: DataFrame, model: Callable[[str, str], dict | None]) -> DataFrame:
    """comment_id, response_id, same_issue, verdict for (comment_id, response_id, comment, response); no answer gives no row."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                answer = model((r.comment or "")[:14_000], (r.response or "")[:14_000])
                if isinstance(answer, dict):
                    out.append((r.comment_id, r.response_id, bool(answer.get("same_issue")), answer.get("verdict")))
            yield pd.DataFrame(out, columns=["comment_id", "response_id", "same_issue", "verdict"])

    return candidates.mapInPandas(run, "comment_id string, response_id string, same_issue boolean, verdict string")
