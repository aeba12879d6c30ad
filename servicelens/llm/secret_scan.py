"""Secret scan through an inverted index of trigrams.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold (in lower case, as the index folds case). An index segment covers the rows of one batch: one pass
over all trigrams of their texts lists the rows of each that the queries use. AND intersects and OR unites the lists,
and only the rows left are searched with the expression. A rule without mandatory trigrams, such as a
run of hexadecimal digits, is searched in every row.

Segments are built where the rows lie, so the scan has no shuffle, and a hot source is only more
batches. Nulls and special cases: a null text is an empty one; repeated rows give repeated rows; all
columns of the input are kept, and result columns replace ones of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import shielded, sliced

try:
    from re import _parser as sre
except ImportError:             # before Python 3.11
    import sre_parse as sre     # type: ignore[no-redef]

MAX_STRINGS = 64                # alternatives kept apart while a query is derived
MASK = "[SECRET]"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PASS = 1 << 21                 # code points looked at together


@dataclass(frozen=True)
class Rule:
    """`least` characters are needed in the group `group` of a match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# Rules, in the order used for ties.
RULES = (
    Rule("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE_KINDS = ("assign", "access", "hex")

# A query is True (every row), a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    flat: list[Query] = []
    for part in parts:
        if part is True:
            if kind == "or":
                return True
        elif isinstance(part, tuple) and part[0] == kind:
            flat.extend(p for p in part[1] if p not in flat)
        elif part not in flat:
            flat.append(part)
    if kind == "or":                        # an alternative that asks for more than another is idle
        asks = [set(p[1]) if isinstance(p, tuple) else {p} for p in flat]
        flat = [p for i, p in enumerate(flat) if not any(a < asks[i] for a in asks)]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str] | None) -> Query:
    """The query of a set of alternatives, one of which stands whole in the text."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _both("or", [_both("and", [s[i:i + 3] for i in range(len(s) - 2)])
                        for s in sorted(strings)])


def _characters(items: list, fold: Callable[[str], str]) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found.add(fold(chr(value)))
        elif name == "RANGE" and value[1] - value[0] < MAX_STRINGS:
            found.update(fold(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def _exact(items: Sequence, fold: Callable[[str], str]) -> tuple[set[str] | None, Query]:
    """The finite set of strings a sequence matches (None: not finite), else its query.

    Runs of parts with finite sets are multiplied out; a part without one ends the run, whose
    trigrams then join the query.
    """
    queries: list[Query] = []
    run: set[str] = {""}
    finite = True

    def close() -> None:
        nonlocal run
        queries.append(_of_strings(run))
        run = {""}

    for op, value in items:
        name, options, inner = str(op), None, True
        if name == "LITERAL":
            options = {fold(chr(value))}
        elif name == "IN":
            options = _characters(value, fold)
        elif name == "SUBPATTERN":
            options, inner = _exact(value[3], fold)
        elif name == "BRANCH":
            each = [_exact(branch, fold) for branch in value[1]]
            if all(strings is not None for strings, _ in each):
                options = set().union(*(strings for strings, _ in each))
            inner = _both("or", [query for _, query in each])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            strings, query = _exact(body, fold)
            if strings is not None and high <= 4:
                options = {"".join(p) for n in range(low, high + 1)
                           for p in product(strings, repeat=n)}
            elif low:                       # at least `low` copies, then anything
                inner = query
                if strings is not None:
                    copies = {"".join(p) for p in product(strings, repeat=min(low, 4))}
                    run = {a + b for a in run for b in copies}
        elif name == "AT":
            continue
        if options is not None and len(run) * len(options) <= MAX_STRINGS:
            run = {a + b for a in run for b in options}
            continue
        finite = False
        close()
        if options is not None and len(options) <= MAX_STRINGS:
            run = set(options)
        else:
            queries.append(inner)
    if finite:
        return run, _of_strings(run)
    close()
    return None, _both("and", queries)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every match of the pattern satisfies."""
    return _exact(sre.parse(pattern), str.lower)[1]


def _rows(query: Query, postings: Callable[[str], np.ndarray], count: int) -> np.ndarray:
    if query is True:
        return np.arange(count)
    if isinstance(query, str):
        return postings(query)
    kind, parts = query
    found = _rows(parts[0], postings, count)
    for part in parts[1:]:
        if kind == "and" and not found.size:
            break
        join = np.intersect1d if kind == "and" else np.union1d
        found = join(found, _rows(part, postings, count))
    return found


def query_trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(query_trigrams, query[1]))


def _keys(codes: np.ndarray) -> np.ndarray:
    """One number for each three neighbouring code points, of 21 bits each."""
    wide = codes.astype(np.uint64)
    return wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42)


def segment_postings(folded: Sequence[str], trigrams: set[str]) -> dict[str, np.ndarray]:
    """For each of the trigrams the texts that hold it, in order, from one pass over all trigrams.

    The texts stand in one array of code points, parted by two zeros. A small table of hashes picks out
    the places whose trigram may be wanted; these are then looked up.
    """
    listed = sorted(t for t in trigrams if "\0" not in t)
    postings = {t: np.array([i for i, x in enumerate(folded) if "\0" in t and t in x], dtype=np.int64) for t in trigrams}
    codes = np.frombuffer("\0\0".join(folded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not listed or len(codes) < 3:
        return postings
    wanted = np.array([_keys(np.array([ord(c) for c in t], dtype="<u4"))[0] for t in listed], dtype=np.uint64)
    order = np.argsort(wanted)
    table = np.zeros(1 << 16, dtype=bool)
    table[wanted * _SPREAD >> np.uint64(48)] = True
    ends = np.cumsum([len(t) + 2 for t in folded])
    for at in range(0, len(codes) - 2, _PASS):              # bounds what is held beside the texts
        keys = _keys(codes[at:at + _PASS + 2])
        places = np.flatnonzero(table[keys * _SPREAD >> np.uint64(48)])
        found = np.minimum(np.searchsorted(wanted, keys[places], sorter=order), len(wanted) - 1)
        right = wanted[order[found]] == keys[places]
        which, rows = order[found[right]], np.searchsorted(ends, places[right] + at, side="right")
        for number in np.unique(which).tolist():
            t = listed[number]
            postings[t] = np.union1d(postings[t], rows[which == number])
    return postings


def segment_spans(texts: list[str], rules: Sequence[Rule] = RULES,
                  queries: Sequence[Query] | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end), sorted; found through one index segment."""
    queries = queries or [trigram_query(r.pattern) for r in rules]
    postings = segment_postings([t.lower() for t in texts], set().union(*map(query_trigrams, queries))).__getitem__
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, query) in enumerate(zip(rules, queries)):
        search = re.compile(rule.pattern).finditer
        for row in _rows(query, postings, len(texts)).tolist():
            for m in search(texts[row]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans[row].append((m.start(), number, m.end()))
    for found in spans:
        found.sort()
    return spans


def masked(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    parts, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents, secrets in `text` masked, and `spans`: array of (kind, start, end) in code points.

    Spans are sorted by start, then by the order of the rules. Masking leaves a text without spans
    as it was; null stays null.
    """
    rules = tuple(rules)
    queries = [trigram_query(r.pattern) for r in rules]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = batch.column("text").to_pylist()
            spans = segment_spans([t or "" for t in raw], rules, queries)
            clean = [masked(t, s) if s else t for t, s in zip(raw, spans)]
            listed = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s]
                      for s in spans]
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(clean, pa.string()), pa.array(listed, pa.list_(_SPAN))],
                [*names, "text", "spans"])

    safe, restored = shielded(docs, ("doc_id", "text"), ("spans",))
    kept = [f for f in safe.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string",
                        "spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return restored(safe.select(*(f.name for f in kept), "text").mapInArrow(scanned, schema))


def span_digest(spans: str = "spans") -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
