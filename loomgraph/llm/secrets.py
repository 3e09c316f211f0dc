"""Secret scans through a trigram inverted index.

Each rule's pattern is parsed and turned into a Boolean query over byte trigrams that every
match must contain (AND of OR of AND, as derived by concatenating and alternating exact
strings). For each block of texts an index maps every queried trigram to the texts that hold
it; the postings of a rule are intersected and united as its query says, and only the
candidates are verified with the pattern. A rule without mandatory trigrams scans every text.
Trigrams are taken over ASCII-lower-cased bytes, so that one index serves rules in either case.

Defined results: null text is empty and has no spans; repeated rows give one row each; spans
are code points, end exclusive, ordered by start and then by the order of the rules; only the
id and text columns are read, so others of any name do no harm; an empty table gives an empty
table. Memory per task grows with one block, or one longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import spread
from .common import id_and_text, id_field, map_chunks


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if `group` has at least `min_length` characters; matches that fail are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

#: Public key formats beyond the base kinds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)?"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9_.~-]+:[^\s:@/]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
MAX_EXACT = 16


def _join(kind: str, parts: Iterable) -> object:
    parts = set(parts)
    if kind == "or" and True in parts:
        return True
    parts.discard(True)
    if not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def _of_strings(strings: set[bytes]) -> object:
    """What a text holds that has one of the strings in it."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _query(parsed) -> tuple[object, set[bytes] | None]:
    """The query of a parsed sequence, and the strings it can match in full if these are few."""
    demands, exact = [], {b""}
    whole = True

    def close() -> None:
        nonlocal exact, whole
        demands.append(_of_strings(exact))
        exact, whole = {b""}, False

    for op, value in parsed:
        options: set[bytes] | None = None
        if op is sre.LITERAL:
            options = {chr(value).encode().lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 8:
            options = {chr(v).encode().lower() for _, v in value}
        elif op is sre.SUBPATTERN:
            demand, options = _query(value[-1])
            if options is None:
                demands.append(demand)
        elif op is sre.BRANCH:
            found = [_query(x) for x in value[1]]
            if all(s is not None for _, s in found):
                options = set().union(*(s for _, s in found))
            else:
                demands.append(_join("or", [d if s is None else _of_strings(s) for d, s in found]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            demand, strings = _query(inner)
            if high == 1 and low == 0 and strings is not None:
                options = strings | {b""}
            elif low == high and low * len(strings or ()) <= 4 and strings is not None:
                options = {b""}
                for _ in range(low):
                    options = {a + b for a in options for b in strings}
            elif low:
                demands.append(demand if strings is None else _of_strings(strings))
        elif op is sre.AT:
            options = {b""}
        if options is None or len(exact) * len(options) > MAX_EXACT:
            close()
            if options is not None:
                exact = options
        else:
            exact = {a + b for a in exact for b in options}
    if whole:
        return _of_strings(exact), exact
    demands.append(_of_strings(exact))
    return _join("and", demands), None


def trigram_query(rule: Rule) -> object:
    """The Boolean trigram query that every text with a match of `rule` satisfies; True if it has no mandatory trigram."""
    return _query(sre_parse.parse(rule.pattern))[0]


def _trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over a block of texts: for each trigram the ascending numbers of the texts that hold it."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.n = len(texts)
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        joined = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        if len(joined) < 3 or not wanted:
            return
        starts = np.r_[0, np.cumsum([len(t) + 2 for t in texts])]
        codes = joined[:-2].astype(np.uint32)
        codes <<= 8
        codes |= joined[1:-1]
        codes <<= 8
        codes |= joined[2:]
        numbers = {int.from_bytes(t, "big"): t for t in wanted}
        # a small table of hashes rules most places out, a search settles the rest
        asked = np.array(sorted(numbers), np.uint32)
        slot = lambda c: (c * np.uint32(2654435761)) >> np.uint32(18)
        marked = np.zeros(1 << 14, bool)
        marked[slot(asked)] = True
        at = np.flatnonzero(marked[slot(codes)])
        at = at[asked[np.minimum(np.searchsorted(asked, codes[at]), len(asked) - 1)] == codes[at]]
        if not len(at):
            return
        found, text = codes[at], np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((text, found))
        found, text = found[order], text[order]
        edges = np.flatnonzero(np.r_[True, np.diff(found) != 0, True])
        for a, b in zip(edges[:-1], edges[1:]):
            self.postings[numbers[int(found[a])]] = np.unique(text[a:b])

    def candidates(self, query: object) -> np.ndarray:
        """Numbers of the texts that satisfy the query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        lists = sorted((self.candidates(p) for p in parts), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if kind == "and" else np.union1d(out, x)
        return out


def spans_of(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.min_length]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each text: `id_col` and spans, an array of (kind, start, end) by start and then by the order of `rules`."""
    if len({r.kind for r in rules}) != len(rules):
        raise ValueError("the kinds of the rules must differ")
    rows = id_and_text(df, id_col, text_col)
    queries = [trigram_query(r) for r in rules]
    wanted = set().union(*map(_trigrams, queries))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([id_field(rows, id_col), T.StructField("spans", T.ArrayType(span))])
    kinds = [r.kind for r in rules]

    def work(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        index = TrigramIndex(texts, wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for k, (rule, query) in enumerate(zip(rules, queries)):
            pattern = rule.compiled()
            least = rule.pattern.endswith("+") and rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.count("[") == 1
            quick = re.compile(f"{rule.pattern[:-1]}{{{rule.min_length},}}".encode()) if least and rule.pattern.isascii() and not rule.ignore_case else None
            for i in index.candidates(query).tolist():
                # one character class repeated: a run that is long enough exists or no match counts
                if quick is not None and not quick.search(texts[i]):
                    continue
                if i not in decoded:
                    decoded[i] = texts[i].decode("utf-8", "replace")
                found[i] += [(a, k, b) for a, b in spans_of(decoded[i], rule, pattern)]
        flat, offsets = [], [0]
        for x in found:
            flat += sorted(x)
            offsets.append(len(flat))
        values = pa.StructArray.from_arrays([pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], ["kind", "start", "end"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=schema.names)

    return map_chunks(rows, work, schema, chunk_bytes=1 << 20)


def redact(text: F.Column, spans: F.Column) -> F.Column:
    """`text` with every span replaced by its kind in angle brackets; of overlapping spans the text is cut once, under the kind of the first."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0).cast("long")).cast("int"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    return F.when(
        F.size(spans) > 0,
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("long")))),
    ).otherwise(text)


def _digest(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(_digest(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
    )
