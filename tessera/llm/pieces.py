"""SentencePiece encoding and decoding with a max-plus scan over chunks of giant documents.

The vocabulary is a BPE model with byte fallback. Its encoding of a text is the one path through the text
whose neighbouring pieces are all compatible: two pieces are when merging their joined text gives the two
again. So encoding is a path of greatest weight with weight 0 for a compatible step and minus infinity for
any other, and parts of a text can be handled on their own:

* a short text falls into words (no piece crosses from a word into the space before the next); the words
  that a task has not met are merged together, one merge in each of them at a time;
* a giant text is cut into chunks. A boundary's states are the pieces that can hold its last character. A
  chunk yields the max-plus matrix between the states at its two ends; matrices are combined associatively
  (prefix and suffix products), which fixes the state at every boundary; then every chunk is traced by
  itself, between its two states.

Ids are packed as little-endian 32-bit integers in a binary column. Decoding joins the pieces' bytes.

Defined cases: null gives null, the empty text no ids; characters that the vocabulary lacks become bytes;
U+2581 in a text is a space to the vocabulary, as in the original library, and decodes to one; repeated rows
get equal ids; empty tables give empty results; further columns stay, but for ``ids``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, settle

SPACE = "▁"
CHUNK = 32768
TASK_CHUNKS = 64  # chunks in a task: some seconds of work
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MEMORY = 400_000  # words and pairs that a task remembers
_TOGETHER, _SHORT = 400_000, 48  # words looked up at a time; characters of a word that is merged with others
_SLOT_BITS = 20
_ROWS = 512  # texts whose words are made distinct together, which bounds the memory of a task
_NEVER, _END, _OFF = np.iinfo(np.int64).max, object(), -np.inf

Step = tuple[int, int]  # where a piece starts and ends


class Vocabulary:
    """Pieces of a model file, and BPE merging as the definition of compatibility."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces")
        self.rank = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.byte_ids = [0] * 256
        self.raw = [b""] * len(spec.pieces)
        for i, p in enumerate(spec.pieces):
            if p.type == 1:
                self.raw[i] = p.piece.encode()
            elif p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(p.piece[1:-1], 16)])
        self.longest = max(map(len, self.rank))
        self.usable = {p for p in self.rank if len(self.merge(p)) == 1}  # the others can never come out
        place = {score: i for i, score in enumerate(sorted(set(self.rank.values()), reverse=True))}
        pairs = []
        for p, score in self.rank.items():
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, place[score], self.ids[p]))
        self.pair, self.pair_place, self.pair_id = (np.array(c, np.int64) for c in zip(*sorted(pairs)))
        self.char_id = np.full(0x110000, -1, np.int32)
        self.char_id[:128] = self.byte_ids[:128]  # a byte's id stands alone: no pair has it
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.fresh()

    def fresh(self) -> None:
        self._fit: dict[tuple[str, str], bool] = {}
        known = "".join(re.escape(c) for c in sorted(p for p in self.ids if len(p) == 1 and not p.isascii()))
        self._odd = re.compile(f"[^\0-\x7f{known}]")  # characters that become several bytes
        self._words = _Words(self)

        # a slot names its only pair; -1 is none, and -2 sends those that share a slot to a search
        slot = self._slot(self.pair)
        self._slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self._slots[slot] = np.arange(len(self.pair))
        self._slots[np.flatnonzero(np.bincount(slot, minlength=1) > 1)] = -2

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_fit", "_words", "_odd", "_slots")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.fresh()

    def merge(self, text: str) -> list[str]:
        """Merge the best neighbouring pair, the leftmost of equals, until none is a piece. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) >= _MEMORY:
                self._fit.clear()
            known = self._fit[a, b] = self.merge(a + b) == [a, b]
        return known

    def piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.usable

    def path(self, text: str, begin: int, before: str | None, stop: int) -> dict[int, int]:
        """For each place from ``begin`` that a path can end at, where its last piece starts.

        ``before`` is the piece that ends at ``begin``; None is the start of a text.
        """
        last: dict[int, int] = {begin: -1}
        for end in range(begin + 1, stop + 1):
            for start in range(end - 1, max(begin, end - self.longest) - 1, -1):
                if start in last:
                    piece = text[start:end]
                    if self.piece(piece):
                        left = before if start == begin else text[last[start] : start]
                        if left is None or self.fits(left, piece):
                            last[end] = start
                            break
        return last

    def pack(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [self.byte_ids[b] for b in p.encode()] if i is None else [i]
        return np.array(out, "<i4").tobytes()

    def trace(self, text: str, last: dict[int, int], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(text[last[end] : end])
            end = last[end]
        return out[::-1]

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of merging, and merged id, of neighbouring ids; the place is _NEVER for none."""
        key = left.astype(np.int64) << 32 | right
        at = self._slots[self._slot(key)]
        crowded = np.flatnonzero(at == -2)
        at[crowded] = np.minimum(np.searchsorted(self.pair, key[crowded]), len(self.pair) - 1)
        known = (self.pair[at] == key) & (left >= 0) & (at >= 0)
        return np.where(known, self.pair_place[at], _NEVER), self.pair_id[at]

    def many(self, words: list[str]) -> list[bytes]:
        """Packed ids of many short words after one space each: one merge in every word at a time."""
        chars = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 1 for w in words])
        ids, word = self.char_id[chars].astype(np.int64), np.repeat(np.arange(len(words)), sizes)
        out: list[bytes] = [b""] * len(words)
        place, merged = np.full(len(ids), _NEVER), np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        place[inner], merged[inner] = self._places(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(place, starts)
            done = best == _NEVER
            if done.any():
                gone = np.repeat(done, counts)
                ended, bounds = ids[gone].astype("<i4").tobytes(), np.cumsum(counts[done]) * 4
                lows = np.r_[0, bounds[:-1]].tolist()
                for w, low, high in zip(word[starts[done]].tolist(), lows, bounds.tolist()):
                    out[w] = ended[low:high]
                ids, word, place, merged = (a[~gone] for a in (ids, word, place, merged))
                if not len(ids):
                    break
                counts, best = counts[~done], best[~done]
            hits = np.flatnonzero(place == np.repeat(best, counts))
            hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # the leftmost of each word
            ids[hits] = merged[hits]
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            shift = np.cumsum(stay) - 1
            ids, word, place, merged = (a[stay] for a in (ids, word, place, merged))
            hits = shift[hits]
            for at in (hits[hits > 0] - 1, hits):
                at = at[at + 1 < len(ids)]
                same = word[at] == word[at + 1]
                place[at[~same]] = _NEVER
                at = at[same]
                place[at], merged[at] = self._places(ids[at], ids[at + 1])
            if len(hits) and hits[-1] + 1 == len(ids):
                place[-1] = _NEVER
        return out

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words that are new."""
        if len(self._words) >= _MEMORY:
            self._words.clear()
        new = list(words.difference(self._words))
        if new and (not 0 < min(map(len, new)) <= max(map(len, new)) < _SHORT or self._odd.search("".join(new))):
            new = [w for w in new if 0 < len(w) < _SHORT and not self._odd.search(w)]
        if new:
            self._words.update(zip(new, self.many(new)))

    def unit(self, text: str) -> bytes:
        """Packed ids of a part that no piece leaves."""
        if len(text) < _SHORT:
            return self.pack(self.merge(text))
        return self.pack(self.trace(text, self.path(text, 0, None, len(text)), 0, len(text)))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of texts; words are looked up, and new ones learned together, for some texts at a time."""
        out: list[bytes | None] = []
        held: list[tuple[bool, list[str]] | None] = []
        size = 0
        for text in [*texts, _END]:
            if text is _END or size >= _TOGETHER:
                self.learn({w for part in held if part and part[0] for w in part[1]})
                look = self._words.__getitem__
                for part in held:
                    out.append(None if part is None else b"".join(map(look, part[1])) if part[0] else self.encode_units(part[1][0]))
                held, size = [], 0
                if text is _END:
                    break
            if text is None:
                held.append(None)
            elif text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
                held.append((True, text.split(" ")))
                size += len(held[-1][1])
            else:
                held.append((False, [SPACE + text.replace(" ", SPACE) if text else ""]))
                size += len(text)
        return out

    def encode_array(self, column: pa.Array) -> pa.Array:
        """Packed ids of a column. Words are made distinct, and their ids put together, by Arrow; only new ones are looked at here."""
        out = []
        for at in range(0, len(column), _ROWS):
            part = column.slice(at, _ROWS)
            plain = pc.and_not(pc.greater(pc.binary_length(part), 0), pc.or_(pc.match_substring(part, SPACE), pc.match_substring(part, "  ")))
            plain = pc.and_not(plain, pc.or_(pc.starts_with(part, " "), pc.ends_with(part, " "))).fill_null(False)
            words = pc.split_pattern(part.filter(plain), " ")
            coded = words.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            self.learn(set(known))
            ids = pa.array(map(self._words.__getitem__, known), pa.binary()).take(coded.indices)
            joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids), b"")
            rest = pa.array(self.encode_all(part.filter(pc.invert(plain)).to_pylist()), pa.binary())
            is_plain = plain.to_numpy(zero_copy_only=False)
            place = np.where(is_plain, np.cumsum(is_plain) - 1, len(joined) + np.cumsum(~is_plain) - 1)
            out.append(pa.concat_arrays([joined, rest]).take(pa.array(place)))
            pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """Texts of a column of packed ids."""
        out, raw = [], pa.array(self.raw, pa.binary())
        for at in range(0, len(ids), _ROWS):
            part = ids.slice(at, _ROWS)
            size = pc.binary_length(part).fill_null(0).to_numpy(zero_copy_only=False)
            each = np.frombuffer(b"".join(x for x in part.to_pylist() if x), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size) // 4].astype(np.int32)), raw.take(pa.array(each)))
            try:
                text = pc.utf8_slice_codeunits(pc.replace_substring(pc.binary_join(lists, b"").cast(pa.string()), SPACE, " "), 1)
                out.append(pc.if_else(part.is_valid(), text, pa.scalar(None, pa.string())))
            except pa.ArrowInvalid:  # some bytes are no UTF-8
                out.append(pa.array([None if x is None else self.decode(x) for x in part.to_pylist()], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def encode_units(self, escaped: str) -> bytes:
        words, found = self._words, _UNITS.findall(escaped)
        self.learn({u[1:] for u in found if u[0] == SPACE and u.count(SPACE) == 1 and len(u) > 1})
        return b"".join([words[u[1:]] if u[0] == SPACE and u.count(SPACE) == 1 and len(u) > 1 else self.unit(u) for u in found])

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text.replace(SPACE, " ")[1:]

    # chunks of giant texts

    def states(self, text: str, cut: int) -> list[Step]:
        """Pieces of the text that can hold the character before ``cut``."""
        out = []
        for start in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(text), start + self.longest) + 1):
                if self.piece(text[start:end]):
                    out.append((start, end))
        return out

    def _clean(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last place in the range where a word ends and a space starts."""
        found = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", text[low:high])]
        return (low + found[0], low + found[-1]) if found else None

    def ends(self, text: str, entry: Step | None, begin: int, cut: int, exits: list[Step]) -> list[bool]:
        """Which exit states a path reaches from an entry state (or from a clean ``begin``)."""
        at = begin if entry is None else entry[1]
        before = None if entry is None else text[entry[0] : entry[1]]
        if at >= cut:  # the entry piece holds the whole chunk
            return [e == entry for e in exits]
        last = self.path(text, at, before, min(len(text), cut - 1 + self.longest))
        out = []
        for start, end in exits:
            if start in last and start >= at:
                left = before if start == at else text[last[start] : start]
                out.append(left is None or self.fits(left, text[start:end]))
            else:
                out.append(False)
        return out

    def matrix(self, text: str, begin: int, cut: int) -> np.ndarray:
        """Max-plus weights between the states at ``begin`` and at ``cut``; a chunk at 0 has one entry."""
        exits = self.states(text, cut) if cut < len(text) else [s for s in self.states(text, cut) if s[1] == len(text)]
        entries: list[Step | None] = [None] if begin == 0 else list(self.states(text, begin))
        out = np.full((len(entries), len(exits)), _OFF)
        clean = self._clean(text, begin, cut)
        if clean:
            tail = self.ends(text, None, clean[1], cut, exits)
            for i, entry in enumerate(entries):
                at = 0 if entry is None else entry[1]
                before = None if entry is None else text[entry[0] : entry[1]]
                if at <= clean[0] and clean[0] in self.path(text, at, before, clean[0]):
                    out[i, tail] = 0
        else:
            for i, entry in enumerate(entries):
                out[i, self.ends(text, entry, begin, cut, exits)] = 0
        return out

    def _around(self, text: str, begin: int, cut: int, entry: int, exit_: int) -> tuple[bytes, str, bytes]:
        """The pieces after the entry state's up to the exit state's: packed ids, whole words between, packed ids."""
        exits = self.states(text, cut) if cut < len(text) else [s for s in self.states(text, cut) if s[1] == len(text)]
        start, end = exits[exit_]
        first = None if begin == 0 else self.states(text, begin)[entry]
        at = 0 if first is None else first[1]
        before = None if first is None else text[first[0] : first[1]]
        if first == (start, end):
            return b"", "", b""
        clean = self._clean(text, begin, cut)
        if clean and at <= clean[0]:
            head = self.trace(text, self.path(text, at, before, clean[0]), at, clean[0])
            tail = self.trace(text, self.path(text, clean[1], None, start), clean[1], start)
            return self.pack(head), text[clean[0] : clean[1]], self.pack([*tail, text[start:end]])
        return self.pack([*self.trace(text, self.path(text, at, before, start), at, start), text[start:end]]), "", b""

    def chunk(self, text: str, begin: int, cut: int, entry: int, exit_: int) -> bytes:
        return self.chunks([(text, begin, cut, entry, exit_)])[0]

    def chunks(self, parts: list[tuple[str, int, int, int, int]]) -> list[bytes]:
        """Packed ids of many chunks; the words within them are looked up together."""
        found = [self._around(*p) for p in parts]
        plain = [bool(words) and SPACE * 2 not in words and " " not in words for _, words, _ in found]
        together = iter(self.encode_array(pa.array([words[1:].replace(SPACE, " ") for (_, words, _), p in zip(found, plain) if p], pa.string())).to_pylist())
        return [head + (next(together) if p else self.encode_units(words)) + tail for (head, words, tail), p in zip(found, plain)]


class _Words(dict):
    """Packed ids of words that follow one space, computed when first met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.vocabulary.unit(SPACE + word)
        return found


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1, initial=_OFF) if a.size and b.size else np.full((len(a), b.shape[1]), _OFF)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by combining neighbours and scanning the half as many results."""
    if len(matrices) <= 1:
        return list(matrices)
    half = scan([combine(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    return [matrices[0] if i == 0 else half[i // 2] if i % 2 else combine(half[i // 2 - 1], matrices[i]) for i in range(len(matrices))]


def boundary_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk on the path of greatest weight."""
    before = scan(matrices)
    after = [m.T for m in scan([m.T for m in matrices[::-1]])][::-1]
    exits = []
    for i in range(len(matrices)):
        weight = before[i][0] + (after[i + 1].max(axis=1) if i + 1 < len(matrices) else 0)
        exits.append(int(weight.argmax()))
        if weight.max(initial=_OFF) == _OFF:
            raise ValueError("no path through the chunks")
    return list(zip([0, *exits[:-1]], exits))


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def _giant_ids(giants: DataFrame, shared, chunk: int, around: int) -> DataFrame:
    """_doc, _hash and ids of giant texts. around: characters of context on either side of a chunk."""
    key = "_doc long, _hash long, part int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, text in zip(*(batch[c] for c in ("_doc", "_hash", "text"))):
                text = SPACE + text.as_py().replace(" ", SPACE)
                parts = -(-len(text) // chunk)
                for i in range(parts):
                    low, high = max(0, i * chunk - around), min(len(text), (i + 1) * chunk + around)
                    # a chunk's own text starts at 0 only if it is the first, and ends at its cut only if it is the last
                    row = [doc.as_py(), mark.as_py(), i, text[low:high], i * chunk - low, min(len(text), (i + 1) * chunk) - low]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["_doc", "_hash", "part", "text", "first", "cut"])

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [shared.value.matrix(t, a, b) for t, a, b in zip(f["text"], f["first"], f["cut"])]
            f = f[["_doc", "_hash", "part"]].assign(rows=[m.shape[0] for m in found], weights=[(m == 0).tobytes() for m in found])
            yield f.astype({"weights": object})

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        matrices = [np.where(np.frombuffer(w, bool).reshape(r, -1), 0.0, _OFF) for w, r in zip(f["weights"], f["rows"])]
        states = boundary_states(matrices)
        return f[["_doc", "_hash", "part"]].assign(entry=[s[0] for s in states], leave=[s[1] for s in states])

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = shared.value.chunks(list(zip(f["text"], f["first"], f["cut"], f["entry"], f["leave"])))
            yield f[["_doc", "_hash", "part"]].assign(ids=pd.Series(ids, index=f.index, dtype=object))

    same = ["_doc", "_hash", "part"]
    parts = settle(giants.select("_doc", "_hash", "text").mapInArrow(cut, f"{key}, text string, first int, cut int"))
    tasks = max(1, -(-parts.count() // TASK_CHUNKS))
    parts = parts.repartition(tasks, *same)  # by number, as files would be packed by size
    weights = parts.mapInPandas(weigh, f"{key}, rows int, weights binary").repartition(tasks, "_doc", "_hash")
    states = settle(weights.groupBy("_doc", "_hash").applyInPandas(choose, f"{key}, entry int, leave int"))
    traced = parts.join(states, same).select(*parts.columns, "entry", "leave").mapInPandas(trace, f"{key}, ids binary")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])

    @F.arrow_udf(T.BinaryType())
    def whole(lists: pa.Array) -> pa.Array:
        return pa.array([b"".join(x) for x in lists.to_pylist()], pa.binary())

    return traced.groupBy("_doc", "_hash").agg(in_order.alias("_ids")).withColumn("_ids", whole("_ids"))


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``ids``; texts of more than ``chunk`` characters go through the scan."""
    vocabulary = load(model_path)
    if chunk < 2 * vocabulary.longest:
        raise ValueError("a chunk is at least twice the longest piece")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.BinaryType())
    def ids_of(text: pa.Array) -> pa.Array:
        return shared.value.encode_array(text)

    docs = docs.drop("ids")
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    short = docs.where(~giant).withColumn("ids", ids_of("text"))
    mark = F.xxhash64("text")
    doc = F.coalesce(F.col("doc_id"), F.lit(0)).cast("long")
    some, own = docs.where(giant), free_name(docs, "giant")
    once = some.select(doc.alias("_doc"), mark.alias("_hash"), "text").dropDuplicates(["_doc", "_hash"])
    ids = _giant_ids(once, shared, chunk, 2 * vocabulary.longest)
    ids = ids.select(F.struct("_doc", "_hash", "_ids").alias(own))
    long = some.join(ids, (doc == F.col(f"{own}._doc")) & (mark == F.col(f"{own}._hash"))).select(*docs.columns, F.col(f"{own}._ids").alias("ids"))
    return short.unionByName(long)


def decoder(docs: DataFrame, model_path: str):
    """A function from a column of packed ids to their text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    @F.arrow_udf(T.StringType())
    def text_of(ids: pa.Array) -> pa.Array:
        return shared.value.decode_array(ids)

    return text_of


def count_ids(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")
