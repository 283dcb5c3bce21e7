"""Chat formatting by incremental black-box rendering.

The template is a function from turns to a string and nothing else is known
of it. Each successive prefix of a conversation is rendered, and so is that
prefix with one-character probes for texts; what a prefix adds to the one
before is its turn's span, and what it adds beyond the probe's is the text.
Two renderings with different probes differ just where texts stand. Where a
template changes what it wrote for earlier turns, or leaves out or repeats a
text, that is detected, and each turn's text is located by probes of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
PROBES = "", ""  # private-use characters: no template escapes or adds them
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    """A backslash before each character that a control string starts with, and before backslashes."""
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", role)


@lru_cache(maxsize=4096)
def _turn(role: str, text: str) -> str:
    return f"### {escape_role(role)}: {escape(text)}</turn>\n"


def default_template(turns: Sequence[Turn]) -> str:
    return "".join([_turn(*t) for t in turns])


def _alike(a: str, b: str) -> int:
    """Length of the common start."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _differences(a: str, b: str) -> list[int]:
    """Places in which two strings of one length differ."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    return np.flatnonzero(x != y).tolist()


def render(turns: Sequence[Turn], template: Template = default_template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(output, span of each turn, span of each turn's text, whether the template rewrote history).

    Two renderings a turn, of the prefix that ends with it. Each is as long as
    the prefix, so the time is that of the template times the turns.
    """
    done, probe, plain = template(()), template(()), True
    rewrote, whole, added = False, [], []
    probes = tuple((role, PROBES[0]) for role, _ in turns)
    for k in range(len(turns)):
        out, shape = template(turns[: k + 1]), template(probes[: k + 1])
        same = _alike(done, out)
        rewrote = rewrote or same < len(done)
        plain = plain and shape.startswith(probe)
        whole.append((same, len(out)))
        added.append(len(out) - len(done) - (len(shape) - len(probe)) + 1)
        done, probe = out, shape
    other = template(tuple((role, PROBES[1]) for role, _ in turns))
    places = _differences(probe, other) if len(probe) == len(other) else []
    if rewrote or not plain or len(places) != len(turns) or min(added, default=0) < 0:
        return done, whole, _one_by_one(turns, template, done, rewrote), rewrote
    texts, moved = [], 0
    for place, n in zip(places, added, strict=True):
        texts.append((place + moved, place + moved + n))
        moved += n - 1
    return done, whole, texts, rewrote


def _one_by_one(turns: Sequence[Turn], template: Template, done: str, rewrote: bool) -> list[tuple[int, int]]:
    """Span of each turn's text, each by three more renderings of the prefix that ends with it."""
    texts = []
    for k, (role, _) in enumerate(turns):
        out = template(turns[: k + 1])
        empty = template((*turns[:k], (role, "")))
        a, b = (template((*turns[:k], (role, p))) for p in PROBES)
        start = _alike(a, b)
        span = start, start + len(out) - len(empty)
        # Spans found on the way may have moved: kept are those that the last rendering still shows.
        texts.append(span if not rewrote or out[slice(*span)] == done[slice(*span)] else (0, 0))
    return texts


def parse(out: str) -> list[Turn]:
    """Turns of an output of the default template."""
    return [(unescape(m[1]), unescape(m[2])) for m in re.finditer(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", out, re.DOTALL)]


FORMATTED = "formatted string, turn_starts array<int>, turn_ends array<int>, text_starts array<int>, text_ends array<int>, loss array<boolean>, rewrites_history boolean"


def format_chats(rows: DataFrame, template: Template = default_template, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text).

    Columns: conv_id, formatted, the spans of turns and of their texts in it
    (code points, end exclusive), loss (whether a turn's text is under the
    loss mask: its role is one of ``loss_roles``), rewrites_history. Null
    texts and roles are empty; turns go by turn (null first), then role and
    text; repeated rows are repeated turns; a null conv_id is a conversation
    like others. Other columns are ignored; no rows give no rows. A
    conversation is one sequence to train on, so it is rendered as a whole in
    one task; very long texts in it are rendered whole.
    """
    roles = frozenset(loss_roles)
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    @F.pandas_udf(FORMATTED)
    def form(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for r, t in zip(role, text, strict=True):
            done, whole, texts, rewrote = render(tuple(zip(r, t, strict=True)), template)
            out.append((done, [s for s, _ in whole], [e for _, e in whole], [s for s, _ in texts], [e for _, e in texts], [x in roles for x in r], rewrote))
        return pd.DataFrame(out, columns=["formatted", "turn_starts", "turn_ends", "text_starts", "text_ends", "loss", "rewrites_history"])

    return chats.select("conv_id", form(F.col("turns.role"), F.col("turns.text")).alias("f")).select("conv_id", "f.*")


def with_extra(rows: DataFrame) -> DataFrame:
    """rows and the conversation whose texts hold the template's own control strings. Rows that are under its id already are turns of it, in order of turn."""
    spark = rows.sparkSession
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output: turns from its control strings, loss text from the mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(out: pd.Series, starts: pd.Series, ends: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = []
        for text, s, e, x in zip(out, starts, ends, loss, strict=True):
            turns = parse(text)
            learnt = "".join(unescape(text[a:b]) for a, b, y in zip(s, e, x, strict=True) if y)
            rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), _sha(learnt), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", read("formatted", "text_starts", "text_ends", "loss").alias("d")).select("conv_id", "d.*")


def _sha(text: str) -> str:
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
         sum(length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length('### : </turn>') + 1) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM chats
"""
