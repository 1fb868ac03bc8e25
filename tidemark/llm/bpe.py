"""Byte-level BPE by a rank file: DuckDB recursive queries inside each task, ordered aggregation to decode."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import bounded_batches

#: Pieces of more bytes than this take the query that contracts many pairs of a piece in one step.
LONG_PIECE = 96
#: Steps of one recursive query over long pieces; unfinished ones start again from where they are.
LONG_STEPS = 24
#: Pieces that a worker remembers between documents, new ones that are encoded together, and bytes of text read before that.
REMEMBERED = 100_000
PIECES_PER_PASS = 50_000
TEXT_PER_PASS = 4_000_000

# For texts of these letters, numbers and spaces alone the split pattern is spelled out with
# explicit classes, which the standard library matches faster. Every character below U+02B0 is covered.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = " \\t-\\r\\x85\\xa0"


def split_pattern(pattern: str) -> tuple[re.Pattern | None, regex.Pattern]:
    """The pattern as such, and a form of it for texts whose characters are all below U+02B0."""
    negated = {"[^\\s\\p{L}\\p{N}]": f"[^{_SPACES}{_LETTERS}{_NUMBERS}]", "\\p{L}": f"[{_LETTERS}]", "\\p{N}": f"[{_NUMBERS}]", "\\S": f"[^{_SPACES}]", "\\s": f"[{_SPACES}]"}
    plain = pattern
    for a, b in negated.items():
        plain = plain.replace(a, b)
    return (None if "\\p" in plain else re.compile(plain)), regex.compile(pattern)


_BEYOND = re.compile("[^\x00-ʯ]")


class PieceTable:
    """The merge table of a rank file in an in-process DuckDB, and the pieces encoded so far."""

    def __init__(self, rank_lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line.strip())}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        # A token that takes part in a merge of lower rank than its own could be followed by that merge at once,
        # so only one pair that makes it may be contracted in a step.
        alone = {x for a, b, r in merges for x in (a, b) if r < x}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        columns = list(zip(*merges, strict=True)) or [(), (), ()]
        self.db.register("merge_rows", pa.table({n: pa.array(c, pa.int32()) for n, c in zip("abr", columns, strict=True)}))
        self.db.register("token_rows", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks]), "alone": pa.array([r in alone for r in ranks.values()])}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows; CREATE TABLE tokens AS SELECT * FROM token_rows")
        self.ranks = ranks
        #: Ids in decimal of the pieces met last and before, and what ids stand for where that is not the piece itself (never, by a sound rank file).
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.changed: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode and decode pieces that are not known yet; what was not met for long is forgotten."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = []
        for p in pieces - self.known.keys():
            if (was := self.older.get(p)) is not None:
                self.known[p] = was
            else:
                new.append(p)
        for at in range(0, len(new), PIECES_PER_PASS):
            some = new[at : at + PIECES_PER_PASS]
            raw = [p.encode("utf-8", "replace") for p in some]
            for i, ids, data in zip(*self._encode(raw), strict=True):
                self.known[some[i]] = ids
                if data != raw[i]:
                    self.changed[some[i]] = data

    def _encode(self, raw: list[bytes]) -> list[list]:
        """Numbers of the pieces, their ids as text, and the bytes that those stand for."""
        size = np.fromiter(map(len, raw), np.int32, len(raw))
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        ready = {i: [t] for i, t in enumerate(map(self.ranks.get, raw)) if t is not None}
        short = size <= LONG_PIECE
        short[list(ready)] = False
        begin = np.concatenate([[0], np.cumsum(size)])
        ready |= self._contract_long({i: ids[begin[i] : begin[i + 1]].tolist() for i in np.flatnonzero(size > LONG_PIECE).tolist() if i not in ready})
        rows = np.flatnonzero(short)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[rows])]), pa.int32()), pa.array(ids[np.repeat(short, size)]))
        self.db.register("pieces", pa.table({"w": pa.array(rows, pa.int32()), "ids": lists}))
        self.db.register("ready", pa.table({"w": pa.array(list(ready), pa.int32()), "ids": pa.array(list(ready.values()), pa.list_(pa.int32()))}))
        return [c.to_pylist() for c in self.db.sql(_CODED).to_arrow_table().columns]

    def _contract_long(self, state: dict[int, list[int]]) -> dict[int, list[int]]:
        done: dict[int, list[int]] = {}
        while state:
            self.db.register("pieces", pa.table({"w": pa.array(list(state), pa.int32()), "ids": pa.array(list(state.values()), pa.list_(pa.int32()))}))
            rows = self.db.execute(_CONTRACT_LONG, [LONG_STEPS]).fetchall()
            state = {w: ids for w, ids, steps in rows if steps >= LONG_STEPS}
            done |= {w: ids for w, ids, steps in rows if steps < LONG_STEPS}
        return done


#: One pair of each piece a step: the leftmost of minimum rank. Token-position rows meet the merge table. Then per piece,
#: and for those that are ``ready``: its ids as text, and the bytes that they stand for.
_CODED = """
WITH RECURSIVE step(i, w, ids) AS (
  SELECT 0, w, ids FROM pieces
  UNION ALL
  SELECT i + 1, s.w, s.ids[: y.p - 1] || [y.r] || s.ids[y.p + 2 :]
  FROM step s JOIN (
    SELECT w, (k // 1048576)::INT AS r, (k % 1048576)::INT AS p FROM (
      SELECT x.w, min(m.r::BIGINT * 1048576 + x.p) AS k
      FROM (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[:-2], 1) AS p FROM step) x
      JOIN merges m ON m.a = x.a AND m.b = x.b GROUP BY x.w)) y ON y.w = s.w),
coded AS MATERIALIZED (SELECT w, arg_max(ids, i) AS ids FROM step GROUP BY w UNION ALL SELECT w, ids FROM ready),
decoded AS (
  SELECT w, string_agg(hex, '' ORDER BY p) AS hex
  FROM (SELECT w, unnest(ids) AS t, generate_subscripts(ids, 1) AS p FROM coded) x JOIN tokens ON tokens.id = x.t GROUP BY w)
SELECT c.w, encode(array_to_string(c.ids, ',')), unhex(d.hex) FROM coded c JOIN decoded d ON d.w = c.w"""

#: The same for long pieces: in a step, every other pair of each run of pairs of the minimum rank (or the first
#: such pair only, if its token can take part in a merge of lower rank), for a stated number of steps.
_CONTRACT_LONG = """
WITH RECURSIVE step(i, w, p, t) AS (
  SELECT 0, w, unnest(generate_series(1, len(ids))), unnest(ids) FROM pieces
  UNION ALL
  SELECT i + 1, w, row_number() OVER (PARTITION BY w ORDER BY p), t FROM (
    SELECT i, w, p, CASE WHEN chosen THEN r ELSE t END AS t, coalesce(lag(chosen) OVER (PARTITION BY w ORDER BY p), false) AS gone
    FROM (
      SELECT i, w, p, t, r, low, hit AND CASE WHEN alone THEN p = min(CASE WHEN hit THEN p END) OVER (PARTITION BY w)
        ELSE row_number() OVER (PARTITION BY w, hit, island ORDER BY p) % 2 = 1 END AS chosen
      FROM (
        SELECT *, p - row_number() OVER (PARTITION BY w, hit ORDER BY p) AS island FROM (
          SELECT *, coalesce(r = low, false) AS hit FROM (
            SELECT s.i, s.w, s.p, s.t, m.r, k.alone, min(m.r) OVER (PARTITION BY s.w) AS low
            FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY p) AS nx FROM step) s
            LEFT JOIN merges m ON m.a = s.t AND m.b = s.nx LEFT JOIN tokens k ON k.id = m.r)))
      WHERE low IS NOT NULL AND i < $1))
  WHERE NOT gone)
SELECT w, list(t ORDER BY p), any_value(i) FROM (SELECT *, max(i) OVER (PARTITION BY w) AS last FROM step) WHERE i = last GROUP BY w"""

_TABLES: dict[str, PieceTable] = {}


def _piece_table(rank_file: str) -> PieceTable:
    if rank_file not in _TABLES:
        with open(rank_file, "rb") as f:
            _TABLES[rank_file] = PieceTable(f.read())
    return _TABLES[rank_file]


def _encoder(rank_file: str, pattern: str, with_ids: bool, with_text: bool):
    fast, full = split_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _piece_table(rank_file)

        def encode(texts: list[str]) -> dict[str, list]:
            split = [(full if fast is None or (not t.isascii() and _BEYOND.search(t)) else fast).findall(t) for t in texts]
            distinct: set[str] = set()
            for pieces in split:
                distinct.update(pieces)
            table.learn(distinct)
            known, changed, out = table.known, table.changed, {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for pieces in split:
                ids = b",".join(map(known.__getitem__, pieces))
                data = b"".join([changed[p] if p in changed else p.encode("utf-8", "replace") for p in pieces]) if changed else "".join(pieces).encode("utf-8", "replace")
                out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    out["ids"].append([int(x) for x in ids.split(b",")] if ids else [])
                if with_text:
                    out["decoded"].append(data)
            return out

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size <= TEXT_PER_PASS:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    size += len(texts[-1]) + 1
                end = at + len(texts)
                distinct = list(dict.fromkeys(texts))  # copies that lie together are encoded once
                out, at_text = encode(distinct), {t: i for i, t in enumerate(distinct)}
                if len(distinct) < len(texts):
                    out = {k: [v[at_text[t]] for t in texts] if v else v for k, v in out.items()}
                columns = [batch.column(0).slice(at, end - at), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32()))), names.append("ids")
                if with_text:
                    columns.append(pa.array(out["decoded"], pa.binary())), names.append("decoded")
                yield pa.record_batch(columns, names)
                at = end

    return run


def encode_bytes(docs: DataFrame, rank_file: str, pattern: str, *, with_ids: bool = False, with_decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text by the ranks of ``rank_file`` and decode the ids again.

    ``rank_file``: a path that every executor can open; lines of base64 token and rank, all 256 single bytes
    among them. ``pattern`` splits the text; each match is
    encoded on its own, without special tokens.

    In each task the distinct pieces of about 4 MB of text go to an in-process DuckDB at a time: a recursive
    query joins their adjacent tokens with the merge table and contracts the leftmost pair of minimum rank of
    each piece until none is left; an ordered aggregation over the token table gives the bytes back, which are
    held against the piece's own, so that only those that differ are kept beside it. A document
    is the sequence of its pieces, so its ids and bytes are those of its pieces in order. Nothing is shuffled.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas),
    decoded_sha256, and with_ids / with_decoded: ids (array of int), decoded (binary). Null text counts as
    empty: 0 tokens and the digests of nothing. Null ids and repeated rows are kept as they are; other columns
    are ignored. Lone surrogates, which Spark strings can't hold, would be encoded as '?'.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded binary" * with_decoded
    texts = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return texts.mapInArrow(_encoder(rank_file, pattern, with_ids, with_decoded), schema)
