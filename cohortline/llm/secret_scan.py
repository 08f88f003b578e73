"""Secrets: three base patterns, and automata inferred from labelled credentials that score every other candidate.

Base spans are assignments to a telling name, access keys and long hexadecimal numbers; each kind is matched leftmost and
without overlap, and a match that is too short is dropped. The labelled credentials are what the base patterns found: the
value of an assignment, the access key, the number. For every kind a probabilistic automaton is inferred from a sample of
them, and one more from ordinary candidates: those that overlap no base span and don't have the format of a kind, judged
against symbols drawn evenly first and then against the ordinary automaton itself (see ``format_automata``).

A candidate is a maximal run of credential characters with a digit and a letter, at least ``SHORTEST`` long, that overlaps no
base span. All of them are scored, whole; one becomes a span of the kind that makes it likeliest if it is at least ``MARGIN``
nats per character, and ``TOTAL`` in all, likelier as that than as an ordinary run.

The fit takes at most ``SAMPLE`` different strings of each kind and of ordinary candidates, first by hash, of at most
``LONGEST`` characters; everything else covers whole texts. Defined results: a NULL text is empty; repeated rows are rows of
their own; a kind without ``FEWEST`` examples adds nothing; an empty table gives no rows; input columns with the name of a
result column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.format_automata import Automaton, codes
from cohortline.llm.frames import append_columns, without

KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"
SAMPLE = 1500
FEWEST = 20
#: Most times that the ordinary examples are judged and their automaton is inferred anew.
ROUNDS = 4
LONGEST = 256
SHORTEST = 16
MARGIN = 0.4
TOTAL = 12.0

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Shorter runs fail anyway, and a run is matched from its first character or not at all.
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: A text without any of these has neither base spans nor candidates.
_TRIGGER = r"(?i)password|passwd|secret|token|api_?key|AKIA|[A-Za-z0-9+/_=-]{%d}" % SHORTEST

Span = tuple[int, int, int]


def base_matches(text: str) -> list[tuple[Span, str]]:
    """``((start, kind, end), credential)`` of all base spans, sorted."""
    found = [((m.start(), 0, m.end()), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [((m.start(), 1, m.end()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [((m.start(), 2, m.end()), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs with a digit and a letter that overlap no base span."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if re.search("[0-9]", run) and re.search("[A-Za-z]", run) and all(e <= m.start() or s >= m.end() for s, _, e in base):
            out.append((m.start(), m.end()))
    return out


def _triggered(column: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, _TRIGGER), False).to_numpy(zero_copy_only=False))


def labelled(docs: DataFrame) -> DataFrame:
    """``(kind, value)``: the different credentials of the base spans and the ordinary candidates, up to ``LONGEST`` long."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            rows = set()
            for text in column.take(pa.array(_triggered(column))).to_pylist():
                base = base_matches(text)
                rows.update((KINDS[span[1]], value) for span, value in base)
                rows.update((ORDINARY, text[a:b]) for a, b in candidates(text, [span for span, _ in base]))
            kept = [r for r in rows if len(r[1]) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], pa.string()) for i in (0, 1)], names=["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton for each kind with enough examples, and one for ordinary candidates (uniform if there are few)."""
    rows = labelled(docs)
    ranked = [rows.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample) for kind in (*KINDS, ORDINARY)]
    union = ranked[0]
    for part in ranked[1:]:
        union = union.union(part)
    found: dict[str, list[str]] = {}
    for row in union.collect():  # at most four samples
        found.setdefault(row["kind"], []).append(row["value"])
    own = {kind: Automaton.inferred(sorted(found[kind])) for kind in KINDS if len(found.get(kind, ())) >= FEWEST}
    # Unnamed credentials are among the ordinary candidates; what has the format of a kind is no example of ordinary text.
    plain = sorted(found.get(ORDINARY, ()))
    models = own
    for _ in range(ROUNDS):
        kept = [value for value, kind in zip(plain, judged(models, plain)) if kind is None]
        if not own or len(kept) < FEWEST or (kept == plain and models is not own):
            break
        plain, models = kept, own | {ORDINARY: Automaton.inferred(kept)}
    return models


def judged(models: dict[str, Automaton], runs: list[str]) -> list[int | None]:
    """The kind of each candidate that is likelier as a credential, else None."""
    kinds = [k for k in KINDS if k in models]
    if not runs or not kinds:
        return [None] * len(runs)
    symbols, begin = codes(runs)
    sizes = np.diff(begin)
    plain = models[ORDINARY].scores(symbols, begin) if ORDINARY in models else -np.log(64) * (sizes + 1)
    gains = np.stack([models[k].scores(symbols, begin) - plain for k in kinds])
    best = gains.argmax(0)
    most = gains.max(0)
    taken = (most >= MARGIN * sizes) & (most >= TOTAL)
    return [KINDS.index(kinds[b]) if t else None for b, t in zip(best.tolist(), taken.tolist())]


def find_secrets(docs: DataFrame, text: str = "text", models: dict[str, Automaton] | None = None, sample: int = SAMPLE) -> DataFrame:
    """All rows of ``docs`` with ``base_spans`` and ``spans`` (arrays of kind, start, end in code points; the second with the
    automata's). ``models`` come from ``fit``, by default on ``docs``."""
    plain = without(docs, ["base_spans", "spans"])
    if models is None:
        models = fit(plain.select(F.col(f"`{text}`").alias("text")), sample)
    handle = plain.sparkSession.sparkContext.broadcast(models)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def compute(batches):
        for batch in batches:
            column = batch.column(text)
            base: list[list] = [[]] * len(column)
            every: list[list] = [[]] * len(column)
            rows = _triggered(column).tolist()
            texts = column.take(pa.array(rows, pa.int64())).to_pylist()
            own = [[span for span, _ in base_matches(t)] for t in texts]
            more = [candidates(t, b) for t, b in zip(texts, own)]
            kinds = iter(judged(handle.value, [t[a:b] for t, c in zip(texts, more) for a, b in c]))
            for i, found, runs in zip(rows, own, more):
                added = [(a, k, b) for a, b in runs if (k := next(kinds)) is not None]
                base[i], every[i] = listed(found), listed(sorted([*found, *added]))
            yield [pa.array(base, kind), pa.array(every, kind)]

    ddl = "array<struct<kind:string,start:long,end:long>>"
    return append_columns(plain, f"base_spans {ddl}, spans {ddl}", compute)
