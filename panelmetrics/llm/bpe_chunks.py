"""BPE encoding and decoding with content-defined chunk reuse.

1. Texts are cut where a rolling hash of the last `WINDOW` bytes says so, anywhere between two characters, so
   equal passages of different documents fall into equal chunks. One small row per chunk is written.
2. Chunks are counted by their 128-bit hash. Of a chunk that stands twice or more, one place is chosen, and the
   chunk is encoded there, once in the corpus. Only the texts with chosen places are looked up, each once.
3. Ids of shared chunks are joined to their places and gathered per text. A text without shared chunks is never moved.
4. Where it has shared chunks, the rest of a text is encoded in place and the pieces are joined. A chunk's ids
   next to a join may be wrong, because the join cuts a word. Joins are repaired: the words around a join
   are encoded again, from a safe point to the left of it to one to the right, and one word more on either side;
   the repair holds when these outer words get the ids that their pieces gave them. Else it widens,
   to the ends of the pieces if need be.

A safe point is a single space between two characters that are no white space: the byte-level pre-tokenizer
always starts a word there, whatever surrounds it, so ids up to a piece's last safe point are those of the whole
text. The grammar of the file is checked on the driver (`has_safe_points`); texts of a file with another one are
encoded whole by the tokenizers library, and so are texts with the string of an added token.

Where the file's ids follow its merges and it would encode each of its tokens as that token (`ids_are_ranks`), pieces
are encoded by merge ranks (tiktoken), which gives the ids of the tokenizers library in a fifth of the time. Decoding
puts together the bytes of the tokens.

Defined cases: a null or empty text has no ids and an empty decoded text; strings of special tokens
in a text become their ids, as the tokenizers library does; rows that repeat, ties and null ids
are encoded each; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import text_of, written
from panelmetrics.llm.lookups import BITS, bitmap_place, key_bitmap, likely_rows, marked
from panelmetrics.llm.words import Powers

WINDOW = 16
CUT_BITS = 10  # a chunk has 2**CUT_BITS bytes on average
LEAST = 128  # shorter chunks are not worth a row; they are encoded where they stand
SLICE = 1 << 18
ROWS = 500
SEGMENT = 1 << 18
MIX = np.uint64(0xD6E8FEB86659FD93)
# The byte-level alphabet and the grammar of its words.
SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def has_safe_points(spec: dict) -> bool:
    """Whether a tokenizer's words start at single spaces, whatever surrounds them."""
    splitter, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        not spec.get("normalizer")
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space", True)
        and (spec.get("decoder") or {}).get("type") == "ByteLevel"
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
            for t in spec.get("added_tokens", [])
        )
    )


def token_bytes(spec: dict) -> dict[bytes, int]:
    """The bytes that each token of the model stands for, with its id."""
    hidden = (b for b in range(256) if b not in SHOWN)
    byte_of = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}


def ids_are_ranks(spec: dict, tokenizer) -> bool:
    """Whether merging by id gives what the file's merges give: ids in the order of merges, each token reached by them."""
    vocabulary = spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [vocabulary.get(a + b) for a, b in merges]
    if None in made or any(a >= b for a, b in zip(made, made[1:])) or len(set(vocabulary.values())) != len(vocabulary):
        return False
    shown = [(t, i) for t, i in ((_text(b), i) for b, i in token_bytes(spec).items()) if t is not None]
    encoded = tokenizer.encode_batch_fast([t for t, _ in shown], add_special_tokens=False)
    # a token over several words is never a word of a text, so it may be split
    return all(e.ids == [i] or len({w for w in e.word_ids}) > 1 for e, (_, i) in zip(encoded, shown, strict=True))


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def library(tokenizer_json: str):
    """The tokenizer of the file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def coder_of(tokenizer_json: str, by_ranks: bool) -> Coder:
    """The coder of a file, kept by a Python worker from task to task."""
    return Coder(tokenizer_json, by_ranks)


class Coder:
    """Encodes and decodes texts and pieces of texts."""

    def __init__(self, tokenizer_json: str, by_ranks: bool):
        spec = json.loads(tokenizer_json)
        self.whole = library(tokenizer_json)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = token_bytes(spec)
        self.said: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.width = np.zeros(max(self.said, default=0) + 1, dtype=np.int64)
        self.width[list(self.said)] = [len(b) for b in self.said.values()]
        self.ranked = None
        if by_ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether no string of an added token stands in the text."""
        return not any(a in text for a in self.added)

    def pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts."""
        if self.ranked is not None:
            return [np.array(self.ranked.encode_ordinary(t), dtype="<u4") for t in texts]
        return [np.array(e.ids, dtype="<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, raw: bytes) -> np.ndarray:
        return self.pieces([raw.decode()])[0]

    def decoded(self, ids: np.ndarray) -> bytes:
        """What plain ids stand for; bytes that are no text become replacement characters."""
        raw = b"".join(map(self.said.__getitem__, ids.tolist()))
        return raw.decode(errors="replace").encode()

    def by_library(self, text: str) -> tuple[bytes, bytes]:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes(), self.whole.decode(ids, skip_special_tokens=False).encode()


def cut_places(held: np.ndarray, starts: np.ndarray, bits: int, powers: Powers) -> np.ndarray:
    """Where texts that lie one behind the other are cut: by a hash of the bytes before, between characters.

    The hash of a window is the difference of two prefix sums of bytes times powers of an odd factor, scaled
    back; sums are taken over a segment at a time. Cuts whose window reaches into the text before are left out,
    so a cut depends on its text alone.
    """
    found = []
    powers.need(SEGMENT + WINDOW)
    for low in range(0, max(len(held) - WINDOW, 0), SEGMENT):
        piece = held[low : low + SEGMENT + WINDOW]
        sums = np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers.up[: len(piece)])
        window = sums[WINDOW:] - sums[:-WINDOW]  # the WINDOW bytes up to place low + WINDOW and on
        rolled = window * powers.down[: len(window)] * MIX
        found.append(np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + low + WINDOW + 1)
    at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    at = at[at < len(held)]
    at = at[(held[at] & 0xC0) != 0x80]
    before = starts[np.searchsorted(starts, at, side="right") - 1]
    return at[at - before > WINDOW]


def text_slices(column: pa.Array):
    """(first row, bytes, starts) of runs of rows, so that no run holds much more than SLICE bytes or one text."""
    texts = [t.as_buffer() for t in column]
    ends = np.array(list(accumulate(len(t) for t in texts)), dtype=np.int64)
    row = 0
    while row < len(texts):
        base = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield row, b"".join(texts[row:stop]), np.concatenate([[0], ends[row : stop - 1] - base])
        row = stop


def chunk_rows(frame: DataFrame, added: list[str], bits: int, least: int) -> DataFrame:
    """(hash, key, start, length) of the chunks of each text (key, text) without added tokens."""
    barred = [a.encode() for a in added]

    def run(batches):
        powers = Powers()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, held, starts in text_slices(batch.column(1)):
                cuts = cut_places(np.frombuffer(held, np.uint8), starts, bits, powers)
                edges = np.unique(np.concatenate([cuts, starts, [len(held)]]))
                owner = np.searchsorted(starts, edges[:-1], side="right") - 1
                found = []
                for at, stop, mine in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist()):
                    if stop - at >= least:
                        found.append((xxhash.xxh3_128_digest(held[at:stop]), keys[row + mine], at - int(starts[mine]), stop - at))
                if any(a in held for a in barred):  # their texts go through the library as a whole
                    some = zip(keys[row : row + len(starts)], batch.column(1).slice(row, len(starts)).to_pylist(), strict=True)
                    odd = {k for k, t in some if any(a in t for a in added)}
                    found = [f for f in found if f[1] not in odd]
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                        names=["hash", "key", "start", "length"],
                    )

    return frame.select("key", "text").mapInArrow(run, "hash binary, key binary, start int, length int")


def safe_points(text: bytes) -> np.ndarray:
    """Single spaces between characters that are no white space (characters that may be are left out)."""
    held = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(held == 32)
    at = at[(at >= 3) & (at < len(held) - 1)]
    last, second, third, after = held[at - 1], held[at - 2], held[at - 3], held[at + 1]

    def white(b: np.ndarray) -> np.ndarray:
        return (b == 32) | ((b >= 9) & (b <= 13)) | ((b >= 28) & (b <= 31))

    def lead(b: np.ndarray) -> np.ndarray:  # first bytes of characters that may be white space
        return (b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3))

    unsure = (second == 0xC2) | (lead(third) & (second >= 0x80) & (last >= 0x80))
    return at[~(white(last) | unsure | white(after) | lead(after))]


class Joiner:
    """Puts the ids of the pieces of one text together."""

    def __init__(self, coder: Coder, text: bytes):
        self.coder, self.text, self.safe = coder, text, safe_points(text)
        self.done: list[np.ndarray] = []
        # the open end: ids from `start` on, where a word of the text starts, with the end of each token
        self.start, self.ids, self.ends = 0, np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def placed(self, start: int, ids: np.ndarray) -> np.ndarray:
        return start + np.cumsum(self.coder.width[ids])

    def within(self, first: int, stop: int) -> np.ndarray:
        """Safe points in a stretch, its ends left out."""
        return self.safe[np.searchsorted(self.safe, first, "right") : np.searchsorted(self.safe, stop, "left")]

    @staticmethod
    def tokens(start: int, ids: np.ndarray, ends: np.ndarray, first: int, stop: int) -> np.ndarray | None:
        """Ids between two places, or None where a token lies across one of them."""
        low = 0 if first == start else np.searchsorted(ends, first) + 1
        high = np.searchsorted(ends, stop) + 1
        if (first != start and ends[low - 1] != first) or high > len(ends) or ends[high - 1] != stop:
            return None
        return ids[low:high]

    def add(self, start: int, ids: np.ndarray) -> None:
        """The next piece, from the place where the last one ends."""
        ends = self.placed(start, ids)
        if not len(self.ids):
            self.start, self.ids, self.ends = start, ids, ends
            return
        left, right = self.within(self.start, start), self.within(start, int(ends[-1]))
        reach = 2
        while True:
            low = int(left[-reach]) if len(left) >= reach else self.start
            if len(right) < reach:  # too few words in the piece: it is encoded again as a whole
                self.close(low)
                span = self.coder.piece(self.text[low : int(ends[-1])])
                self.start, self.ids, self.ends = low, span, self.placed(low, span)
                return
            high = int(right[reach - 1])
            span = self.coder.piece(self.text[low:high])
            places = self.placed(low, span)
            inner = int(left[-1]) if len(left) else low
            agree = (
                (self.start, self.ids, self.ends, low, inner, inner > low),
                (start, ids, ends, int(right[0]), high, True),
            )
            if all(not asked or self.same(low, span, places, *piece, a, b) for *piece, a, b, asked in agree):
                self.close(low)
                self.done.append(span)
                rest = np.searchsorted(ends, high) + 1
                self.start, self.ids, self.ends = high, ids[rest:], ends[rest:]
                return
            reach *= 2

    def same(self, low, span, places, start, ids, ends, first, stop) -> bool:
        """Whether a repair gives the words in a stretch the ids that their piece gave them."""
        repaired, given = (self.tokens(*piece, first, stop) for piece in ((low, span, places), (start, ids, ends)))
        return repaired is not None and given is not None and np.array_equal(repaired, given)

    def close(self, place: int) -> None:
        """Ids of the open end up to a place are final."""
        kept = 0 if place == self.start else np.searchsorted(self.ends, place) + 1
        self.done.append(self.ids[:kept])

    def result(self) -> np.ndarray:
        return np.concatenate([*self.done, self.ids])


def joined_ids(coder: Coder, text: bytes, shared: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Ids of a text from its shared chunks (start, length, ids); the rest is encoded here."""
    joiner, at = Joiner(coder, text), 0
    for start, length, ids in sorted(shared):
        if start > at:
            joiner.add(at, coder.piece(text[at:start]))
        joiner.add(start, np.frombuffer(ids, "<u4"))
        at = start + length
    if at < len(text):
        joiner.add(at, coder.piece(text[at:]))
    return joiner.result()


def encode_documents(
    documents: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    cut_bits: int = CUT_BITS,
    least: int = LEAST,
    bits: int = BITS,
) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit numbers), decoded.

    `tokenizer` is the path of a byte-level BPE tokenizer file, read on the driver and sent to the tasks (a file
    of bounded size). `cut_bits` sets the mean chunk size, `least` the size from which chunks are
    shared, `bits` the size of the two bitmaps of texts that are looked up.
    """
    held = Path(tokenizer).read_text(encoding="utf-8")
    spec = json.loads(held)
    by_pieces = has_safe_points(spec)
    by_ranks = by_pieces and ids_are_ranks(spec, library(held))
    file = documents.sparkSession.sparkContext.broadcast(held)
    frame = documents.select(documents[id_column].alias("doc_id"), text_of(documents, text_column).alias("text"))
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string"

    def coded(coder: Coder, ids: pa.Array, texts: list[bytes], shared: list | None = None) -> pa.RecordBatch:
        rows = []
        for raw, pieces in zip(texts, shared or [None] * len(texts), strict=True):
            text = raw.decode()
            if not by_pieces or not coder.plain(text):
                rows.append(coder.by_library(text))
                continue
            found = joined_ids(coder, raw, pieces) if pieces else coder.piece(raw)
            back = coder.decoded(found)
            rows.append((found.tobytes(), back))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())],
            names=["doc_id", "ids", "decoded"],
        )

    def slices(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield batch.slice(start, ROWS)

    def raws(column: pa.Array) -> list[bytes]:
        return [t.as_buffer().to_pybytes() for t in column]

    if not by_pieces:

        def whole(batches):
            coder = coder_of(file.value, False)
            for piece in slices(batches):
                yield coded(coder, piece.column(0), raws(piece.column(1)))

        return frame.mapInArrow(whole, schema)

    frame = frame.withColumn("key", F.unhex(F.md5("text")))
    added = [t["content"] for t in spec.get("added_tokens", [])]
    chunks = written(chunk_rows(frame, added, cut_bits, least), "chunks")
    first = F.min(F.struct("key", "start", "length")).alias("first")
    repeated = chunks.groupBy("hash").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    chosen = written(
        repeated.groupBy("first.key").agg(F.collect_list(F.struct("hash", "first.start", "first.length")).alias("places")), "chosen"
    )
    likely = likely_rows(frame.select("key", "text"), key_bitmap(chosen, "key", bits), "key", bits)
    texts = likely.groupBy("key").agg(F.first("text").alias("text"))  # copies of a text meet as one row per task

    def encode_chosen(batches):
        coder = coder_of(file.value, by_ranks)
        for piece in slices(batches):
            hashes, ids = [], []
            for text, places in zip(raws(piece.column(0)), piece.column(1).to_pylist(), strict=True):
                for place in places:
                    hashes.append(place["hash"])
                    ids.append(coder.piece(text[place["start"] : place["start"] + place["length"]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())], names=["hash", "ids"])

    codes = written(chosen.join(texts, "key").select("text", "places").mapInArrow(encode_chosen, "hash binary, ids binary"), "codes")
    gathered = written(
        chunks.join(codes, "hash").groupBy("key").agg(F.collect_set(F.struct("start", "length", "ids")).alias("pieces")), "pieces"
    )
    bitmap = key_bitmap(gathered, "key", bits)

    def unshared(batches):
        coder = coder_of(file.value, by_ranks)
        for batch in batches:
            rest = batch.filter(pa.array(~marked(bitmap, batch.column(2))))
            for piece in slices([rest]):
                yield coded(coder, piece.column(0), raws(piece.column(1)))

    def join_pieces(batches):
        coder = coder_of(file.value, by_ranks)
        for piece in slices(batches):
            shared = [[(p["start"], p["length"], p["ids"]) for p in x] if x else None for x in piece.column(2).to_pylist()]
            yield coded(coder, piece.column(0), raws(piece.column(1)), shared)

    alone = frame.select("doc_id", "text", bitmap_place("key", bits).alias("place")).mapInArrow(unshared, schema)
    looked_up = likely_rows(frame, bitmap, "key", bits).join(gathered.hint("merge"), "key", "left")
    return alone.unionByName(looked_up.select("doc_id", "text", "pieces").mapInArrow(join_pieces, schema))
