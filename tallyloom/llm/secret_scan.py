"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over byte trigrams is derived: every match
must hold them. The texts of a batch are indexed by just the trigrams that some query names,
the postings are intersected and united, and only the remaining candidates are matched. A rule
whose expression forces no trigram is matched against every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as C, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import arrow_schema, as_schema, field, sliced

# Kind, expression, group whose length counts, least length.
BASE_RULES = (
    ("assign",
     r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
     r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
     r"""([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# Formats that well-known issuers publish.
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
RULES = BASE_RULES + MORE_RULES

_FEW = 16  # alternatives that a trigram may have at one place


def _fold(code: int) -> str:
    """The character as the index has it: only A-Z are folded."""
    return chr(code + 32 if 65 <= code <= 90 else code)


def _strings(node) -> list[set[str] | None]:
    """A sequence of parsed items as the places of a match: a set of ASCII characters in lower case
    per place, or None where anything of any length may stand."""
    places: list[set[str] | None] = []
    for op, value in node:
        if op is C.LITERAL:
            places.append({_fold(value)} if value < 128 else None)
        elif op is C.IN:
            got: set[str] = set()
            for kind, v in value:
                if kind is C.LITERAL and v < 128:
                    got.add(_fold(v))
                elif kind is C.RANGE and v[1] < 128 and v[1] - v[0] < _FEW:
                    got |= {_fold(i) for i in range(v[0], v[1] + 1)}
                else:  # a class, a negation, characters beyond ASCII: no set that holds all
                    got = set()
                    break
            places.append(got if 0 < len(got) <= _FEW else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            one = _strings(inner)
            many = one * min(low, _FEW)
            places += many[:_FEW]
            if high != low or len(one) * low > _FEW:  # more of the same may follow here
                places.append(None)
        elif op is C.SUBPATTERN and not _has_flags(value):
            places += _strings(value[-1])
        else:
            places.append(None)
    return places


def _has_flags(group) -> bool:
    """Whether a group switches flags, which change what its characters match."""
    return bool(group[1] or group[2])


def trigram_query(node) -> tuple:
    """Boolean query of a parsed expression: ("and", …), ("or", …), a trigram, or ("any",).

    Consecutive places with few characters give an "or" of trigrams; a branch gives the "or" of
    its alternatives; parts that may be left out give nothing.
    """
    parts: list[tuple] = []
    run: list[tuple] = []

    def close():
        parts.extend(_of_places(_strings(run)))
        run.clear()

    for item in node:
        op, value = item
        inner = value[-1] if op is C.SUBPATTERN and not _has_flags(value) else None
        if op is C.BRANCH or inner is not None and any(o is C.BRANCH for o, _ in inner):
            close()
            options = value[1] if op is C.BRANCH else None
            if options is not None:
                choices = [trigram_query(x) for x in options]
                if all(c != ("any",) for c in choices):
                    parts.append(("or", *choices))
            else:
                got = trigram_query(inner)
                if got != ("any",):
                    parts.append(got)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] == 0:
            close()
            # left out or there: what stands on either side is joined only when it is left out,
            # so both texts are possible and neither is forced across this place
        else:
            run.append(item)
    close()
    if not parts:
        return ("any",)
    return parts[0] if len(parts) == 1 else ("and", *parts)


def _of_places(places: list[set[str] | None]) -> list[tuple]:
    out = []
    for i in range(len(places) - 2):
        three = places[i:i + 3]
        if all(three) and np.prod([len(p) for p in three]) <= _FEW:
            grams = sorted(a + b + c for a in three[0] for b in three[1] for c in three[2])
            out.append(("gram", grams[0]) if len(grams) == 1 else
                       ("or", *(("gram", g) for g in grams)))
    return out


def rule_query(pattern: str) -> tuple:
    """Query that every text with a match fulfils; a pattern with flags is left to a full scan."""
    parsed = parser.parse(pattern)
    return ("any",) if parsed.state.flags & ~re.UNICODE else trigram_query(parsed)


def grams_of(query: tuple) -> set[str]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*(grams_of(q) for q in query[1:] if isinstance(q, tuple)))


class Postings:
    """Inverted index of one batch of texts: trigram → ordered row numbers.

    Holds only the trigrams asked for; texts are folded to lower case (A-Z).
    """

    def __init__(self, grams: list[str]):
        self.grams = grams
        self.slot = np.zeros(1 << 24, np.uint8)
        for i, g in enumerate(grams):
            a, b, c = g.encode()
            self.slot[a << 16 | b << 8 | c] = i + 1
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold

    def index(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        data = self.fold[np.frombuffer(b"\x00\x00".join(texts) + b"\x00\x00", np.uint8)]
        ends = np.cumsum([len(t) + 2 for t in texts])
        found: list[np.ndarray] = []
        step = 1 << 22
        for s in range(0, len(data) - 2, step):
            d = data[s:s + step + 2].astype(np.uint32)
            slots = self.slot[d[:-2] << 16 | d[1:-1] << 8 | d[2:]]
            at = np.flatnonzero(slots)
            rows = np.searchsorted(ends, at + s, side="right")
            found.append(np.unique(rows << 8 | slots[at]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return {g: both[(both & 255) == i + 1] >> 8 for i, g in enumerate(self.grams)}


def candidates(query: tuple, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows that may hold a match."""
    kind = query[0]
    if kind == "any":
        return np.arange(n)
    if kind == "gram":
        return index[query[1]]
    sets = [candidates(q, index, n) for q in query[1:]]
    out = sets[0]
    for s in sets[1:]:
        out = np.intersect1d(out, s, True) if kind == "and" else np.union1d(out, s)
    return out


def scanner(rules=RULES) -> Callable[[list[str]], list[list[tuple[int, int, str]]]]:
    """Function from texts to their spans (start, end, kind), ordered by start and rule.

    Matches of a rule are leftmost and do not overlap; those too short are dropped.
    """
    queries = [rule_query(r[1]) for r in rules]
    grams = sorted(set().union(set(), *(grams_of(q) for q in queries)))
    if len(grams) > 255:
        raise ValueError("the rules name more than 255 trigrams")
    postings = Postings(grams)
    # a greedy repeat alone matches the same spans when its least length is part of it
    compiled = [re.compile(r[1][:-1] + f"{{{r[3]},}}" if re.fullmatch(r"\[[^\]]+\]\+", r[1]) else r[1])
                for r in rules]

    def scan(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        index = postings.index([t.encode() for t in texts])
        found: list[list] = [[] for _ in texts]
        for k, ((kind, _, group, least), query, expr) in enumerate(zip(rules, queries, compiled)):
            for row in candidates(query, index, len(texts)):
                for m in expr.finditer(texts[row]):
                    if m.end(group) - m.start(group) >= least:
                        found[row].append((m.start(), k, m.end(), kind))
        return [[(s, e, kind) for s, _, e, kind in sorted(f)] for f in found]

    return scan


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES
) -> DataFrame:
    """(id, spans): array of (kind, start, end) in code points, end exclusive, by start and rule.

    Spans of different rules may overlap. Null and empty texts have none. Null ids and repeated
    rows are kept, one row out per row in; a very long text is one row of one task. Further
    columns are not read.
    """
    schema = as_schema([field(docs, id_col),
                        ("spans", "array<struct<kind:string,start:int,end:int>>")])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for b in sliced(batches):
            found = scan([t or "" for t in b.column(1).to_pylist()])
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), pa.array(spans, target.field(1).type)],
                schema=target)

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans replaced by the kind of its first in brackets."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """All rows and columns, the secrets in the text replaced by their kind.

    Null texts stay null, empty ones empty. Of overlapping spans the first in order names the whole run.
    Repeated rows and null ids stay as they are; an empty table stays empty; a very long text is one row
    of one task. Columns of any other name pass through.
    """
    at, target = docs.columns.index(text_col), arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for b in sliced(batches):
            arrays = [b.column(i).cast(target.field(i).type) for i in range(b.num_columns)]
            texts = arrays[at].to_pylist()
            found = scan([t or "" for t in texts])
            arrays[at] = pa.array([t if t is None else redact_text(t, f) for t, f in zip(texts, found)],
                                  target.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return docs.mapInArrow(run, docs.schema)
