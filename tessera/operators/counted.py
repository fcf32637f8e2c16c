"""Tokens of texts, cut and counted in Arrow batches: Spark deals the texts out, and a task returns counts instead of tokens.

The tokens are those of index_tokens. Texts of Latin letters and general punctuation alone are folded and cut by a table of their
letters; what any other text holds is cut by index_tokens itself, before the batch is made.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ACCENTED, FOLDED, PLAIN, SPECIAL, index_tokens, is_ascii

#: Bytes of text that a task counts at once.
PART = 4 << 20
BLOCK = "collection string, token string, slot long, n long, max_tf int, min_len int, ids array<long>, tfs array<int>, lens array<int>"
#: Letters of U+0000 to U+024F are in the table; U+2000 to U+206F has none.
_TABLE, _OTHERS = 0x250, r"[^\x{0}-\x{24F}\x{2000}-\x{206F}]"


def _letters() -> np.ndarray:
    """For each code point its folded letter or digit, 0 for what separates tokens."""
    special, plain = str.maketrans(SPECIAL, FOLDED), str.maketrans(ACCENTED, PLAIN)
    folded = (chr(c).translate(special).lower().translate(plain) for c in range(_TABLE))
    return np.array([ord(c) if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else 0 for c in folded] + [0], np.uint32)


LETTERS = _letters()
#: For each byte its folded ASCII letter or digit, 0 for what separates tokens; bytes of other letters stay.
_BYTES = bytes([*LETTERS[:128].astype(np.uint8), *range(128, 256)])


def _folded(raw: np.ndarray, letters: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with the letters beyond ASCII that begin at ``heads`` folded too, and where texts end among them."""
    letters, three = letters.copy(), raw[heads] >= 0xE0  # U+2000 to U+206F, which has no letters
    code = (raw[heads].astype(np.int32) & 0x1F) << 6 | raw[heads + 1] & 0x3F
    folded = LETTERS[np.where(three, _TABLE, np.minimum(code, _TABLE))]
    none, plain, wide = folded == 0, (folded > 0) & (folded < 0x80), folded > 0x7FF
    for where in (heads[none], heads[none] + 1, heads[three] + 2):
        letters[where] = 0
    letters[heads[plain]] = folded[plain]
    two, three = ~none & ~plain & ~wide, heads[wide] + 1
    letters[heads[two]], letters[heads[two] + 1] = 0xC0 | folded[two] >> 6, 0x80 | folded[two] & 0x3F
    letters[heads[wide]], letters[three] = 0xE0 | folded[wide] >> 12, 0x80 | folded[wide] >> 6 & 0x3F
    gone = heads[plain] + 1
    ends = ends - np.searchsorted(gone, ends) + np.searchsorted(three, ends)
    if len(three):
        letters, gone = np.insert(letters, three + 1, 0x80 | folded[wide] & 0x3F), gone + np.searchsorted(three, gone)
    return np.delete(letters, gone) if len(gone) else letters, ends


def _cut(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text has, and all of them in order."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or ends[0] == ends[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    raw, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    letters, others = np.frombuffer(raw.tobytes().translate(_BYTES), np.uint8), np.flatnonzero(raw >= 0xC0)
    if len(others):
        letters, ends = _folded(raw, letters, others, ends)
    kept = letters > 0
    begins, stops = kept.copy(), kept.copy()
    begins[1:] &= ~kept[:-1]
    stops[:-1] &= ~kept[1:]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    begins[heads] = kept[heads]
    stops[heads[1:] - 1] = kept[heads[1:] - 1]
    at = np.flatnonzero(begins)
    places = np.append(0, np.cumsum(np.flatnonzero(stops) + 1 - at)).astype(np.int32)
    return np.diff(np.searchsorted(at, ends)), pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(letters[kept].tobytes()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, tokens and others) in parts of about PART bytes of text."""
    for rows in batches:
        size = pc.add(pc.fill_null(pc.binary_length(rows["text"]), 0), pc.multiply(pc.fill_null(pc.list_value_length(rows["tokens"]), 0), 8))
        part = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // PART
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                yield rows.slice(low, high - low)


def tokens_of(text: pa.Array, others: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, token) of all tokens, those of a row in order, and how many each row has; ``others`` are tokens that Spark has cut."""
    counts, tokens = _cut(text.fill_null(""))
    more = pc.fill_null(pc.list_value_length(others), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(text)), counts)
    if more.any():
        row, tokens = np.append(row, np.repeat(np.arange(len(text)), more)), pa.concat_arrays([tokens, pc.list_flatten(others)])
    return row, tokens, counts + more


def _asked(rows: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tf) of each row's distinct tokens that are among ``words``, by row and place, and the rows' lengths."""
    row, tokens, lens = tokens_of(rows["text"], rows["tokens"])
    place = pc.index_in(tokens, value_set=words)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    keys, tf = np.unique(row[known] * max(len(words), 1) + place.drop_null().to_numpy(), return_counts=True)
    return keys // max(len(words), 1), keys % max(len(words), 1), tf.astype(np.int32), lens.astype(np.int32)


def _counts(rows: pa.RecordBatch, words: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, tf) of each row's distinct tokens by row and code, the rows' lengths, and what the codes stand for.

    With ``words`` codes are places among them, from 1; all other tokens of a row are one, 0.
    """
    if words is not None:
        row, place, tf, lens = _asked(rows, words)
        rest = lens - np.bincount(row, tf, rows.num_rows).astype(np.int32)
        has = np.flatnonzero(rest)
        return np.append(row, has), np.append(place + 1, np.zeros_like(has)), np.append(tf, rest[has]), lens, words
    row, tokens, lens = tokens_of(rows["text"], rows["tokens"])
    coded = tokens.dictionary_encode()
    code, known, n = coded.indices.to_numpy(), coded.dictionary, len(coded.dictionary)
    keys, tf = np.unique(row * max(n, 1) + code, return_counts=True)
    return keys // max(n, 1), keys % max(n, 1), tf.astype(np.int32), lens.astype(np.int32), known


def cuttable(value: Column) -> tuple[Column, Column]:
    """The text where the table is enough, its tokens where it isn't."""
    other = ~F.is_valid_utf8(value) | (~is_ascii(value) & value.rlike(_OTHERS))
    return F.when(~other, value), F.when(other, index_tokens(value))


def _texts(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """Columns to keep, text and tokens (cuttable)."""
    value, tokens = cuttable(F.col(text))
    return rows.select(*keep, value.alias("text"), tokens.alias("tokens"))


def count_tokens(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("id",), words: pa.Array | None = None) -> DataFrame:
    """(keep, token, tf, doc_len): a row for each distinct token of each row of ``rows``.

    With ``words`` (a bounded list) token is the place of a word in it, and what else a row has is one row with a null token.
    """
    ready = _texts(rows, text, *keep)
    kind = T.StringType() if words is None else T.LongType()
    added = [T.StructField("token", kind), T.StructField("tf", T.IntegerType()), T.StructField("doc_len", T.IntegerType())]
    schema = T.StructType([*(ready.schema[c] for c in keep), *added])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            row, code, tf, lens, known = _counts(rows, words)
            token = known.take(pa.array(code)) if words is None else pa.array(code - 1, pa.int64(), mask=code == 0)
            yield pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(row)) for c in keep), token, pa.array(tf), pa.array(lens[row])], schema.names)

    return ready.mapInArrow(count, schema)


def count_asked(rows: DataFrame, words: pa.Array, text: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, tokens, tfs, doc_len): a row for each row of ``rows``, with places in ``words`` (a bounded list) for its tokens among them."""
    ready = _texts(rows, text, *keep)
    kinds = {"tokens": T.ArrayType(T.IntegerType()), "tfs": T.ArrayType(T.IntegerType()), "doc_len": T.IntegerType()}
    schema = T.StructType([*(ready.schema[c] for c in keep), *(T.StructField(c, kind) for c, kind in kinds.items())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            row, place, tf, lens = _asked(rows, words)
            offsets = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, tf)]
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in keep), *lists, pa.array(lens)], schema.names)

    return ready.mapInArrow(count, schema)


def count_lists(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, tokens, tfs, doc_len): a row for each row of ``rows``, with its distinct tokens."""
    ready = _texts(rows, text, *keep)
    kinds = {"tokens": T.ArrayType(T.StringType()), "tfs": T.ArrayType(T.IntegerType()), "doc_len": T.IntegerType()}
    schema = T.StructType([*(ready.schema[c] for c in keep), *(T.StructField(c, kind) for c, kind in kinds.items())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            row, code, tf, lens, known = _counts(rows)
            offsets = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (known.take(pa.array(code)), pa.array(tf))]
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in keep), *lists, pa.array(lens)], schema.names)

    return ready.mapInArrow(count, schema)


def count_heads(rows: DataFrame, text: str = "text") -> DataFrame:
    """(token, df): how many rows have a token, added up in parts; with a null token the rows' lengths together (in df)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            _, code, _, lens, known = _counts(rows)
            df = np.append(np.bincount(code, minlength=len(known)), lens.sum())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([known, pa.nulls(1, pa.string())]), pa.array(df.astype(np.int64))], ["token", "df"])

    return _texts(rows, text).mapInArrow(count, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def count_in_blocks(rows: DataFrame, text: str = "text", width: int = 1024) -> DataFrame:
    """Blocks of passages (id, collection, text), a slot being ``width`` neighbouring ids, and, with a null token, the lengths of the passages of a slot.

    A slot whose texts are counted in two parts has two blocks of a token. Passages without an id have none.
    """
    slot = F.floor(F.col("id") / width)
    ready = _texts(rows, text, "id", "collection").where("id is not null").repartition("collection", slot).sortWithinPartitions("collection", "id")

    def lists(parts: list[np.ndarray], starts: np.ndarray) -> list[pa.Array]:
        offsets = pa.array(np.append(starts, len(parts[0])).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(p)) for p in parts]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            row, code, tf, lens, known = _counts(rows)
            ids, where = rows["id"].to_numpy(), rows["collection"].dictionary_encode().indices.fill_null(-1).to_numpy()
            slots = ids // width
            group = np.append(0, np.cumsum((np.diff(slots) != 0) | (np.diff(where) != 0)))
            place, token = np.arange(len(ids)), np.full(len(ids), len(known))  # the row of a passage's length comes after its tokens
            row, code, tf = np.append(row, place), np.append(code, token), np.append(tf, np.zeros(len(ids), np.int32))
            key = group[row] * (len(known) + 1) + code
            order = np.lexsort((row, key))
            row, code, tf, key = row[order], code[order], tf[order], key[order]
            starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
            first, length = row[starts], lens[row]
            code = code[starts]
            columns = [
                rows["collection"].take(pa.array(first)), known.take(pa.array(code, mask=code == len(known))), pa.array(slots[first]), pa.array(np.diff(np.append(starts, len(row)))),
                pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), *lists([ids[row], tf, length], starts),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["collection", "token", "slot", "n", "max_tf", "min_len", "ids", "tfs", "lens"])

    return ready.mapInArrow(build, BLOCK)
