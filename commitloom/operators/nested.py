"""Deeply nested records to linked flat rows, by vectorised structural indexing.

A batch of JSON texts is one byte array.  Bitmaps of unescaped quotes, brackets
and delimiters are built with array operations, nesting depth is a prefix sum
over the brackets outside strings, and the parent, key and array position of
every container come from binary searches in the sorted index.  Only the rows
that are emitted are touched one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import complete, last_of_keys

#: Bytes that are indexed at once; a longer text is indexed alone.
CHUNK_BYTES = 1 << 20
#: Characters after which a batch of rows is handed on.
BATCH_CHARS = 1 << 25

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.int8)
for _i, _c in enumerate(b"{}[]:,"):
    _CLASS[_c] = _i + 1

SCHEMA = "parent_key string, child_path string, parent_path string, field string, name string, pos int, depth int, json string"
_ARROW = pa.schema([("parent_key", pa.string()), ("child_path", pa.string()), ("parent_path", pa.string()), ("field", pa.string()), ("name", pa.string()), ("pos", pa.int32()), ("depth", pa.int32()), ("json", pa.string())])


def _index(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
    """The structural index of texts that lie side by side in ``buf``."""
    n, docs = len(buf), len(starts)
    doc_of = np.repeat(np.arange(docs, dtype=np.int32), ends - starts)
    quote = buf == 0x22
    backslash = buf == 0x5C
    if backslash.any():
        at = np.arange(n, dtype=np.int64)
        plain = np.maximum.accumulate(np.where(backslash, -1, at))
        plain = np.maximum(plain, starts[doc_of] - 1)
        before = np.zeros(n, np.int64)
        before[1:] = at[:-1] - plain[:-1]
        before[starts[starts < n]] = 0
        quote &= (before & 1) == 0
    count = np.cumsum(quote, dtype=np.int64)
    base = np.where(starts > 0, count[np.maximum(starts - 1, 0)], 0) if n else np.zeros(docs, np.int64)
    inside = ((count - base[doc_of]) & 1) == 1
    kind = _CLASS[buf]
    tok = np.flatnonzero((kind > 0) & ~inside)
    tkind, tdoc = kind[tok], doc_of[tok]
    opens, closes = (tkind == OPEN_OBJECT) | (tkind == OPEN_ARRAY), (tkind == CLOSE_OBJECT) | (tkind == CLOSE_ARRAY)
    running = np.cumsum(opens.astype(np.int64) - closes)
    first = np.searchsorted(tdoc, np.arange(docs))
    zero = np.where(first > 0, running[np.maximum(first - 1, 0)], 0) if len(tok) else np.zeros(docs, np.int64)
    after = running - zero[tdoc]
    total = np.zeros(docs, np.int64)
    quotes = np.zeros(docs, np.int64)
    if n:
        filled = ends > starts
        quotes[filled] = count[ends[filled] - 1] - base[filled]
    np.add.at(total, tdoc, opens.astype(np.int64) - closes)
    lowest = np.zeros(docs, np.int64)
    np.minimum.at(lowest, tdoc, after)
    return {"tok": tok, "kind": tkind, "doc": tdoc, "depth": after + closes, "opens": opens, "closes": closes, "quotes": np.flatnonzero(quote), "opening": np.flatnonzero(quote & inside), "balanced": (total == 0) & (lowest >= 0) & (quotes % 2 == 0)}


def _spans(texts: list[bytes], keys: list, prefixes: list[str | None], fields: frozenset[str], trusted: bool, with_json: bool) -> tuple[list[tuple], list[tuple[bytes, object, str | None]]]:
    """Rows of the texts, and the texts inside strings (or with repeated keys) that are to be indexed next."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = b"".join(texts)
    buf = np.frombuffer(data, np.uint8)
    ix = _index(buf, starts, ends)
    again: list[tuple[bytes, object, str | None]] = []
    good = ix["balanced"] & (sizes > 0)
    if not trusted:
        for i in np.flatnonzero(good):
            whole = complete(texts[i])
            if whole is None:  # of a repeated key the last counts
                again.append((last_of_keys(texts[i].decode()).encode(), keys[i], prefixes[i]))
            good[i] = whole is True
    keep = good[ix["doc"]]
    tok, kind, doc, depth, opens, closes = (ix[k][keep] for k in ("tok", "kind", "doc", "depth", "opens", "closes"))
    oi = np.flatnonzero(opens)
    if not len(oi):
        return [], again
    big = np.int64(len(buf) + 1)
    levels = int(depth.max()) + 2
    group = doc.astype(np.int64) * levels + depth
    cpos, cdoc, cdepth, cgroup, ckind = tok[oi], doc[oi], depth[oi], group[oi], kind[oi]
    order = np.argsort(cgroup * big + cpos, kind="stable")
    index = (cgroup * big + cpos)[order]

    def holder(g: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The container of that document and depth that opened last before p."""
        return order[np.searchsorted(index, g * big + p, side="right") - 1]

    parent = np.full(len(oi), -1, np.int64)
    deep = cdepth > 1
    parent[deep] = holder(cgroup[deep] - 1, cpos[deep])
    ki, mi = np.flatnonzero(kind == COLON), np.flatnonzero(kind == COMMA)
    kin, min_ = holder(group[ki], tok[ki]), holder(group[mi], tok[mi])
    colons, commas = np.sort(kin * big + tok[ki]), np.sort(min_ * big + tok[mi])
    quotes = ix["quotes"]
    names: dict[bytes, str] = {}

    def key_before(container: np.ndarray, p: np.ndarray) -> list[str]:
        """The key of the member of each container that lies at p."""
        at = colons[np.searchsorted(colons, container * big + p) - 1] % big
        t = np.searchsorted(quotes, at) - 1
        out = []
        for a, b in zip(quotes[t - 1] + 1, quotes[t]):
            raw = data[a:b]
            if (name := names.get(raw)) is None:
                name = names[raw] = json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()
            out.append(name)
        return out

    def place_of(container: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The array position in each container of the element that lies at p."""
        return np.searchsorted(commas, container * big + p) - np.searchsorted(commas, container * big)

    path = np.full(len(oi), None, object)
    above = np.full(len(oi), None, object)  # path of the nearest object that is a row
    name_of = np.full(len(oi), None, object)
    place = np.full(len(oi), -1, np.int64)
    top = np.array([p is None for p in prefixes], bool)
    for i in np.flatnonzero((cdepth == 1) & ~top[cdoc]):
        path[i] = prefixes[cdoc[i]]
        above[i] = prefixes[cdoc[i]].rpartition("/")[0] or None  # refined by the caller's rows, see _emit
    by_depth = np.argsort(cdepth, kind="stable")
    level = np.searchsorted(cdepth[by_depth], np.arange(int(cdepth.max()) + 2))
    for d in range(2, int(cdepth.max()) + 1):
        at = by_depth[level[d] : level[d + 1]]
        p = parent[at]
        live = np.array([x is not None for x in path[p]], bool) | ((d == 2) & top[cdoc[at]])
        at, p = at[live], p[live]
        keyed = ckind[p] == OPEN_OBJECT
        label = np.full(len(at), None, object)
        if keyed.any():
            label[keyed] = key_before(p[keyed], cpos[at[keyed]])
            name_of[at[keyed]] = label[keyed]
        if (~keyed).any():
            place[at[~keyed]] = place_of(p[~keyed], cpos[at[~keyed]])
            label[~keyed] = place[at[~keyed]].astype(str).astype(object)
        if d == 2:
            outer = top[cdoc[at]]
            for i, lab, o, k in zip(at, label, outer, keyed):
                if not o:
                    path[i] = f"{path[parent[i]]}/{lab}"
                elif k and lab in fields:
                    path[i] = lab
        else:
            path[at] = path[p] + "/" + label
        for i, q in zip(at, p):
            above[i] = path[q] if ckind[q] == OPEN_OBJECT and path[q] is not None and "/" in path[q] else above[q]
    rows = []
    if with_json:
        xi = np.flatnonzero(closes)
        close = np.empty(len(oi), np.int64)
        close[order] = np.sort(group[xi] * big + tok[xi]) % big
    for i in np.flatnonzero(ckind == OPEN_OBJECT):
        if (own := path[i]) is not None and "/" in own:
            rows.append((keys[cdoc[i]], own, above[i], own.partition("/")[0], name_of[i], None if place[i] < 0 else int(place[i]), own.count("/"), data[cpos[i] : close[i] + 1].decode() if with_json else None))
    # strings that may be JSON themselves: values whose text begins with a bracket
    first = ix["opening"]
    first = first[good[np.searchsorted(ends, first, side="right")]]
    maybe = first[np.isin(buf[first + 1], np.frombuffer(b"{[ \\", np.uint8))]
    if len(maybe) and len(tok):
        t = np.searchsorted(tok, maybe) - 1
        maybe, t = maybe[t >= 0], t[t >= 0]
        owner_doc = np.searchsorted(ends, maybe, side="right")
        same = doc[t] == owner_doc
        maybe, t = maybe[same], t[same]
        inside = holder(group[t], tok[t]) if len(t) else t
        last = quotes[np.searchsorted(quotes, maybe) + 1] if len(t) else t
        for a, b, k, c in zip(maybe, last, kind[t], inside):
            if k == COLON and ckind[c] == OPEN_OBJECT:
                label = key_before(np.array([c]), np.array([a]))[0]
            elif ckind[c] == OPEN_ARRAY and k in (COMMA, OPEN_ARRAY):
                label = str(place_of(np.array([c]), np.array([a]))[0])
            else:
                continue
            outer = cdepth[c] == 1 and top[cdoc[c]]
            if path[c] is None and not (outer and ckind[c] == OPEN_OBJECT and label in fields):
                continue
            inner = json.loads(data[a : b + 1]).strip(" \t\r\n")
            if inner[:1] in ("{", "[") and complete(inner) is not False:
                again.append((inner.encode("utf-8", "surrogatepass"), keys[cdoc[c]], label if outer else f"{path[c]}/{label}"))
    return rows, again


def index_texts(texts: Iterable[tuple[bytes, object]], fields: Iterable[str], trusted: bool = False, with_json: bool = False) -> list[tuple]:
    """Rows of some texts; strings that hold JSON are read as that JSON, to any depth."""
    work = [(t, k, None) for t, k in texts]
    wanted, out = frozenset(fields), []
    while work:
        rows, work = _spans([w[0] for w in work], [w[1] for w in work], [w[2] for w in work], wanted, trusted, with_json)
        out += rows
        trusted = False
    return _emit(out)


def _emit(rows: list[tuple]) -> list[tuple]:
    """Rows whose parent lies outside a JSON string: the parent is the longest path that is a row."""
    known = {(r[0], r[1]) for r in rows}
    out = []
    for r in rows:
        up = r[2]
        while up is not None and (r[0], up) not in known:
            up = up.rpartition("/")[0] or None
            if up is not None and "/" not in up:
                up = None
        out.append((*r[:2], up, *r[3:]))
    return out


def flatten_json(df: DataFrame, key: str, text: str, fields: list[str], trusted: bool = False, with_json: bool = False) -> DataFrame:
    """One linked row per object in or below ``fields`` of the JSON texts in column ``text``.

    Columns of the result: ``parent_key`` (``key`` as a string), ``child_path``
    (field, then map keys, field names and array positions, joined by ``/``),
    ``parent_path`` (the path of the nearest enclosing row, null for children of
    the record itself), ``field``, ``name`` and ``pos`` (the object's own key or
    position), ``depth`` and, with ``with_json``, its ``json`` text.

    Texts that are null, empty or no complete strict JSON give no rows, unless
    ``trusted`` says that they were written by ``to_json``.  Null elements of
    arrays count for positions and give no rows, empty objects give a row.  Of
    repeated keys in one object the last counts.  A string that holds JSON is
    read as that JSON.  Repeated input rows give repeated rows; other columns of
    ``df`` are ignored, whatever their names.
    """
    wanted = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            held: list[tuple[bytes, object]] = []
            size = 0

            def rows() -> Iterator[pa.RecordBatch]:
                found, first, filled = index_texts(held, wanted, trusted, with_json), 0, 0
                for n, r in enumerate(found, 1):  # paths of deep records are long
                    filled += sum(len(x) for x in r if isinstance(x, str))
                    if filled > BATCH_CHARS or n == len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found[first:n]], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)
                        first, filled = n, 0

            for k, t in zip(keys, texts):
                if not t.is_valid:
                    continue
                raw = t.as_buffer().to_pybytes()
                if held and size + len(raw) > CHUNK_BYTES:
                    yield from rows()
                    held, size = [], 0
                held.append((raw, k))
                size += len(raw)
            if held:
                yield from rows()

    return df.select(F.col(key).cast("string"), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(run, SCHEMA)
