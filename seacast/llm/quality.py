"""Quality rules as a short-circuit cascade, ordered by rejections per cost."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seacast.llm.common import without
from seacast.session import stored

_WORDS = r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
_LINES = r"filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
_LETTERS = "length(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ''))"
_UPPER = "length(regexp_replace(coalesce(text, ''), '[^A-Z]+', ''))"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: For each 3-word window of ``_w``: 32 bits of its hash above 32 zero bits.
_HASHES = "CASE WHEN size(_w) < 4 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), 32)) END"
#: The hashes with the positions of their windows, sorted; empty where no two hashes are equal.
_KEYS = "CASE WHEN size(array_distinct(_h)) = size(_h) THEN array() ELSE sort_array(transform(_h, (x, i) -> x | i)) END"


def _repeated() -> str:
    """Words inside 3-word windows found twice or more, from ``_w`` and its ``_k``.

    Equal windows have equal hash bits and so are neighbours among the keys. Only the windows of such
    neighbours are sorted again by their words, which settles which of them are equal.
    """
    pairs = "filter(_k, (x, j) -> j > 0 AND shiftright(x, 32) = shiftright(_k[greatest(j - 1, 0)], 32))"
    firsts = "filter(_k, (x, j) -> j < size(_k) - 1 AND shiftright(x, 32) = shiftright(_k[least(j + 1, size(_k) - 1)], 32))"
    close = f"array_distinct(concat({pairs}, {firsts}))"
    windows = "sort_array(transform(c, x -> struct(_w[CAST(x & 4294967295 AS INT)] AS a, _w[CAST(x & 4294967295 AS INT) + 1] AS b, _w[CAST(x & 4294967295 AS INT) + 2] AS c, CAST(x & 4294967295 AS INT) AS i)))"
    same = "(s[{0}].a = s[{1}].a AND s[{0}].b = s[{1}].b AND s[{0}].c = s[{1}].c)"
    found = (
        f"filter(sequence(0, size(s) - 1), j -> (j > 0 AND {same.format('j', 'j - 1')}) "
        f"OR (j < size(s) - 1 AND {same.format('j', 'j + 1')}))"
    )
    covered = f"size(array_distinct(flatten(transform({found}, j -> array(s[j].i, s[j].i + 1, s[j].i + 2)))))"
    return _let(close, "c", f"CASE WHEN size(c) = 0 THEN 0 ELSE {_let(windows, 's', covered)} END")


#: Measures of a text by name; each is one SQL expression over ``text``.
MEASURES = {
    "n_words": f"size({_WORDS})",
    "word_chars": f"length(array_join({_WORDS}, ''))",
    "n_symbols": "length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', ''))",
    "n_lines": f"size({_LINES})",
    "n_dup_lines": _let(_LINES, "l", "size(l) - size(array_distinct(l))"),
    "n_repeat_words": _let(_WORDS, "_w", _let(_HASHES, "_h", _let(_KEYS, "_k", _repeated()))),
    "n_letters": _LETTERS,
    "n_upper": _UPPER,
    "n_shouts": "length(regexp_replace(coalesce(text, ''), '[^!]+', ''))",
}


#: The column that holds a document's words while its rules are judged.
WORDS = "_quality_words"


def staged_measures() -> dict[str, str]:
    """The measures over a document whose words are there as a column."""
    return {n: e.replace(_WORDS, WORDS) for n, e in MEASURES.items()}


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``reject`` holds: SQL with measures in braces, such as ``{n_words} < 50``."""

    name: str
    reject: str


BASE = [Rule("short", "{n_words} < 50"), Rule("repeated_windows", "100 * {n_repeat_words} > 50 * {n_words}")]
RULES = [
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("repeated_lines", "2 * {n_dup_lines} > {n_lines}"),
    Rule("word_length", "{word_chars} < 3 * {n_words} OR {word_chars} > 10 * {n_words}"),
    Rule("upper_case", "2 * {n_upper} > {n_letters}"),
    Rule("shouts", "10 * {n_shouts} > 3 * {n_words}"),
]


def with_measures(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with the named measures as long columns; they replace columns of the same name. Words and window
    keys are made once per document, as columns of their own, for all measures that use them."""
    out = (*names, "_w", "_h", "_k")
    plain = {n: MEASURES[n].replace(_WORDS, "_w") for n in names} | ({"n_repeat_words": _repeated()} if "n_repeat_words" in names else {})
    staged = docs.select(*without(docs, *out), F.expr(_WORDS).alias("_w"))
    if "n_repeat_words" in names:
        staged = staged.withColumn("_h", F.expr(_HASHES)).withColumn("_k", F.expr(_KEYS))
    return staged.select(*without(docs, *out), *[F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in plain.items()])


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7, repeats: int = 16) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a written sample of about ``sample_rows`` rows drawn over all of ``docs``.

    The words of the sample are written with it, as the cascade has them once per document. A rule's seconds are those
    of a job that judges every sampled row ``repeats`` times, run a second time (so its code is there), less
    those of a job that only repeats the rows: what starts and plans a job is in neither.
    """
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed).withColumn(WORDS, F.expr(_WORDS))
    sample = stored(sample, "quality-sample")
    often = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(what) -> tuple[float, float | None]:
        taken = []
        for _ in range(2):
            start = time.perf_counter()
            share = often.agg(what).collect()[0][0]
            taken.append(time.perf_counter() - start)
        return taken[-1], share

    base, _ = timed(F.avg(F.expr(f"CAST(length(text) > size({WORDS}) + _again AS INT)")))
    found = []
    for rule in rules:
        # The repeat's number is part of the test, so that it is not judged once for all repeats.
        taken, share = timed(F.avg(F.expr(f"CAST(_again > 0 AND ({rule.reject.format(**staged_measures())}) AS INT)")))
        found.append((rule, max(taken - base, 1e-4), float(share or 0.0)))
    return found


def by_rejections_per_cost(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per second first; ties keep the given order."""
    return [rule for rule, _, _ in sorted(estimates, key=lambda e: -e[2] / max(e[1], 1e-6))]


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, order: list[Rule] | None = None, measured: list[str] = ()) -> DataFrame:
    """``docs`` with ``kept`` and ``failed_rule`` (null when kept).

    The rules form one CASE: a rule runs only for documents that all earlier rules let pass. ``order``
    defaults to the order found on a sample; it changes the cost and which rule is named, never ``kept``.
    ``measured`` names measures that ``docs`` already has as columns. A null text counts as empty; an
    undecided rule (null) does not reject; a very long text is judged whole. Columns named like the results are replaced; rows are
    neither added nor dropped, so repeated rows and an empty table pass through.
    """
    rules = BASE + RULES if rules is None else rules
    if order is None:
        order = by_rejections_per_cost(estimate(docs, rules))
    names = staged_measures() | {n: f"`{n}`" for n in measured}
    cases = " ".join(f"WHEN {r.reject.format(**names)} THEN '{r.name}'" for r in order)
    failed = F.expr(f"CASE {cases} END") if order else F.lit(None).cast("string")
    kept = without(docs, "kept", "failed_rule", WORDS)
    if WORDS in cases:
        # Split once a document, for all rules that its words decide. A one-element inline, because a filter on the
        # verdict moves below a projection and splits the text anew wherever a rule names the words.
        docs = docs.select(*kept, F.inline(F.array(F.struct(F.expr(_WORDS).alias(WORDS)))))
    judged = docs.select(*kept, failed.alias("failed_rule"))
    return judged.withColumn("kept", F.col("failed_rule").isNull())
