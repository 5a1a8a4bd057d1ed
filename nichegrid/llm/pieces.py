"""Encoding and decoding with the pieces of a SentencePiece model, by a streaming Viterbi search.

The ids of a text are the segmentation with the greatest sum of piece scores; of equal sums the one
whose last piece is longer. Only a window of back pointers is kept: a later piece can start no
further back than the longest piece, so once the paths of all those positions run through one
boundary, the ids before it are final. A place that no piece can span (before a space, when the
vocabulary has no piece with a space inside) is such a boundary by itself, which lets short chunks
between two of them be remembered.

The model file is read where the query is planned; its pieces travel with the tasks. Spaces become
the space mark and one mark is put in front, as in the model; no other normalisation is made, and
a character without a piece becomes its UTF-8 bytes, so decoding gives back the text exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: chunks up to so many characters are remembered, so many at a time
REMEMBERED_CHARS, REMEMBERED = 48, 1 << 17
#: bytes of text looked up together, and chunks searched side by side
LOT, SIDE_BY_SIDE = 1 << 20, 8192


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: text pieces with id and score, the ids of the 256 bytes, and every id's bytes."""

    scored: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    decoded: tuple[bytes, ...]
    longest: int = field(init=False)
    unknown: float = field(init=False)
    #: every start of a piece -> the piece's score and packed id, or None where it is only a start
    starts: dict[str, tuple[float, bytes] | None] = field(init=False)
    splits: bool = field(init=False)

    def __post_init__(self):
        put = object.__setattr__
        put(self, "longest", max(map(len, self.scored), default=1))
        starts = dict.fromkeys(piece[:n] for piece in self.scored for n in range(1, len(piece)))
        starts |= {piece: (score, packed([i])) for piece, (i, score) in self.scored.items()}
        put(self, "starts", starts)
        # a character without a piece costs more than any piece
        put(self, "unknown", min((s for _, s in self.scored.values()), default=0.0) - 10.0)
        # whether no piece goes on to a space mark after another character
        put(self, "splits", not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scored))


def load(path: str) -> Pieces:
    """The pieces of a ``.model`` file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored, byte_ids, decoded = {}, [-1] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            scored[piece] = (i, model.get_score(i))
            decoded.append(piece.replace(SPACE, " ").encode())
    if -1 in byte_ids:
        raise ValueError("the model has no pieces for single bytes")
    return Pieces(scored, tuple(byte_ids), tuple(decoded))


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return np.array(ids, "<i4").tobytes()


def stream(pieces: Pieces, chars: str) -> Iterator[bytes]:
    """The packed ids of ``chars`` (spaces already marked) in final lots; memory is a window, not the text."""
    starts, longest, unknown = pieces.starts, pieces.longest, pieces.unknown
    n, none, get = len(chars), -math.inf, starts.get
    done = 0  # everything before is final
    # of positions from ``done`` on: best sum, where its last piece starts, that piece's id
    score, back, last = [0.0], [0], [b""]
    for start in range(n):
        ahead = min(n, start + longest) - done + 1
        if len(score) < ahead:
            more = ahead - len(score)
            score += [none] * more
            back += [0] * more
            last += [b""] * more
        sum_, at = score[start - done], start - done + 1
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = get(chars[start:end], 0)
            if piece:
                if sum_ + piece[0] > score[at]:
                    score[at], back[at], last[at] = sum_ + piece[0], start, piece[1]
            elif piece == 0:  # nothing begins like this
                break
            at += 1
        at = start - done + 1
        if sum_ + unknown > score[at] and get(chars[start]) is None:
            ids = packed([pieces.byte_ids[b] for b in _raw(chars[start])])
            score[at], back[at], last[at] = sum_ + unknown, start, ids
        if start + 1 - done >= 4 * longest:
            alive = set(range(start + 2 - longest, start + 2))
            while len(alive) > 1:  # replace the last position by the one its path comes from
                furthest = max(alive)
                alive.discard(furthest)
                alive.add(back[furthest - done])
            (meet,) = alive
            if meet > done:
                yield _path(back, last, done, meet)
                score, back, last = score[meet - done :], back[meet - done :], last[meet - done :]
                done = meet
    if n > done:
        yield _path(back, last, done, n)


def _path(back: list[int], last: list[bytes], done: int, end: int) -> bytes:
    lots = []
    while end > done:
        lots.append(last[end - done])
        end = back[end - done]
    lots.reverse()
    return b"".join(lots)


def _raw(chars: str) -> bytes:
    return chars.encode("utf-8", "surrogateescape")


class _Side:
    """The same search for many short chunks side by side, each between two boundaries that no piece spans.

    A chunk starts and ends in one state, so its window is the chunk. Pieces are found by walking a
    trie whose steps are sorted numbers (node, character); sums are taken place by place for all
    chunks at once.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        letters = sorted({c for piece in pieces.scored for c in piece})
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        number = {c: i for i, c in enumerate(letters)}
        nodes, steps = {"": 0}, []
        for prefix in sorted(pieces.starts, key=len):
            nodes[prefix] = len(nodes)
            steps.append((nodes[prefix[:-1]] * len(letters) + number[prefix[-1]], nodes[prefix]))
        steps.sort()
        self.steps, self.child = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        self.score, self.id = np.full(len(nodes), -np.inf), np.zeros(len(nodes), np.int64)
        for piece, (i, score) in pieces.scored.items():
            self.score[nodes[piece]], self.id[nodes[piece]] = score, i

    def __call__(self, chunks: list[str]) -> list[bytes]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        raw = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        total = len(raw)
        letter = np.minimum(np.searchsorted(self.codes, raw), len(self.codes) - 1)
        known = self.codes[letter] == raw
        offset = np.concatenate([[0], sizes.cumsum()])
        left = np.repeat(offset[1:], sizes) - np.arange(total)  # characters from here to the chunk's end
        scores, ids = [], []
        at, node = np.arange(total), np.zeros(total, np.int64)
        for length in range(1, int(sizes.max()) + 1):
            go = left[at] >= length
            at, node = at[go], node[go]
            step = node * len(self.codes) + letter[at + length - 1]
            place = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            go = (self.steps[place] == step) & known[at + length - 1]
            at, node = at[go], self.child[place[go]]
            if not len(at):
                break
            own, which = np.full(total, -np.inf), np.zeros(total, np.int64)
            own[at], which[at] = self.score[node], self.id[node]
            scores.append(own)
            ids.append(which)
        if not scores:
            scores, ids = [np.full(total, -np.inf)], [np.zeros(total, np.int64)]
        # a character without a piece: its byte, or a mark that the chunk needs more than one
        lone = scores[0] == -np.inf
        single = np.array(self.pieces.byte_ids, np.int64)
        ids[0][lone] = np.where(raw[lone] < 128, single[np.minimum(raw[lone], 127)], -1)
        scores[0][lone] = self.pieces.unknown

        # one more place per chunk than it has characters
        first = offset[:-1] + np.arange(len(chunks))
        best = np.full(total + len(chunks), -np.inf)
        back, last = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        best[first] = 0.0
        for place in range(int(sizes.max())):
            alive = np.flatnonzero(sizes > place)
            for length, (own, which) in enumerate(zip(scores, ids, strict=True), 1):
                alive = alive[sizes[alive] >= place + length]
                if not len(alive):
                    break
                char, here = offset[alive] + place, first[alive] + place
                sums = best[here] + own[char]
                better = np.flatnonzero(sums > best[here + length])
                to = here[better] + length
                best[to], back[to], last[to] = sums[better], length, which[char[better]]

        lots, owners, now, open_ = [], [], first + sizes, np.arange(len(chunks))
        while len(open_):
            lots.append(last[now[open_]])
            owners.append(open_)
            now[open_] -= back[now[open_]]
            open_ = open_[now[open_] > first[open_]]
        flat, owner = np.concatenate(lots[::-1]), np.concatenate(owners[::-1])
        order = np.argsort(owner, kind="stable")
        flat, counts = flat[order], np.bincount(owner, minlength=len(chunks))
        ends = 4 * np.concatenate([[0], counts.cumsum()])
        long = set(np.unique(owner[order][flat < 0]).tolist())
        data, ends = flat.astype("<i4").tobytes(), ends.tolist()
        return [
            b"".join(stream(self.pieces, chunks[i])) if i in long else data[ends[i] : ends[i + 1]]
            for i in range(len(chunks))
        ]


def encoder(pieces: Pieces) -> Callable[[Sequence[bytes | None]], Iterator[bytes | None]]:
    """From the UTF-8 bytes of texts to their packed ids."""
    known: dict[str, bytes] = {}
    side = _Side(pieces)
    chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if pieces.splits else "(?s).+")
    mark = packed([pieces.byte_ids[b] for b in SPACE.encode()])

    def marked(raw: bytes) -> list[list[str]]:
        # a mark that the text itself holds is not a space: it goes as its three bytes
        parts = raw.decode("utf-8", "surrogateescape").split(SPACE)
        parts = [part.replace(" ", SPACE) for part in parts]
        parts[0] = SPACE + parts[0]
        return [chunks.findall(part) for part in parts]

    def coded(chunk: str) -> bytes:
        return b"".join(stream(pieces, chunk))

    def lot(texts: Sequence[bytes | None]) -> Iterator[bytes | None]:
        cut = [marked(raw) if raw else raw for raw in texts]
        new = {x for text in cut if text for part in text for x in part if len(x) <= REMEMBERED_CHARS} - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {x for text in cut if text for part in text for x in part if len(x) <= REMEMBERED_CHARS}
        todo = sorted(new, key=len)
        for i in range(0, len(todo), SIDE_BY_SIDE):
            known.update(zip(todo[i : i + SIDE_BY_SIDE], side(todo[i : i + SIDE_BY_SIDE]), strict=True))
        for text in cut:
            yield mark.join(b"".join([known.get(x) or coded(x) for x in part]) for part in text) if text else text

    def encode(texts: Sequence[bytes | None]) -> Iterator[bytes | None]:
        first = 0
        while first < len(texts):
            last = size = 0
            for last in range(first, len(texts)):
                size += len(texts[last] or b"")
                if size >= LOT:
                    break
            yield from lot(texts[first : last + 1])
            first = last + 1

    return encode


def decoder(pieces: Pieces) -> Callable[[Sequence[int] | None], bytes | None]:
    table = pieces.decoded

    def decode(ids: Sequence[int] | None) -> bytes | None:
        if ids is None:
            return None
        return b"".join([table[i] for i in ids])[1:]  # without the mark put in front

    return decode


def _lists(rows: list[bytes | None]) -> pa.Array:
    sizes = np.array([0, *(len(x) // 4 if x else 0 for x in rows)], dtype="int32").cumsum(dtype="int32")
    values = pa.array(np.frombuffer(b"".join(x for x in rows if x), "<i4"))
    missing = pa.array([x is None for x in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(sizes), values, mask=missing)




def _parts(batch: pa.Array, rows: int = 256) -> list[pa.Array]:
    """Slices of a batch, so that only a few rows are Python objects at a time."""
    return [batch.slice(i, rows) for i in range(0, max(len(batch), 1), rows)]


def _numbers(lists: pa.Array) -> Iterator[list[int] | None]:
    starts = lists.offsets.to_numpy().tolist()
    for i, none in enumerate(lists.is_null().to_pylist()):
        yield None if none else lists.values[starts[i] : starts[i + 1]].to_numpy(zero_copy_only=False).tolist()


def encode(documents: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids") -> DataFrame:
    """``documents`` with a column of ids. Null text gives null, empty text no ids.

    A column that already has the name ``ids`` is replaced. Rows neither move nor meet.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = encoder(pieces)
        for batch in batches:
            yield pa.concat_arrays([_lists(list(one(part.to_pylist()))) for part in _parts(batch)])

    return documents.withColumn(ids, run(F.col(text).cast("binary")))


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of their ids, the exact inverse of ``encode``."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = decoder(pieces)
        for batch in batches:
            # a row at a time: all ids of a batch as Python numbers would take ten times their room
            yield pa.concat_arrays([pa.array(map(one, _numbers(part)), pa.binary()) for part in _parts(batch)])

    return rows.withColumn(text, run(F.col(ids)).cast("string"))


def _checked(documents: DataFrame, pieces: Pieces, coded: str, text: str = "text") -> DataFrame:
    """``documents`` with a column ``coded``: the ids and whether decoding gives the text back (null for no text).

    Encoding and decoding take one worker and one vocabulary, and the ids do not travel back to be decoded.
    """

    @F.arrow_udf("struct<ids: array<int>, same: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to_ids, to_text = encoder(pieces), decoder(pieces)
        for batch in batches:
            lots = []
            for part in _parts(batch):
                raw = part.to_pylist()
                ids = _lists(list(to_ids(raw)))
                same = [None if r is None else to_text(n) == r for n, r in zip(_numbers(ids), raw, strict=True)]
                lots.append(pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "same"]))
            yield pa.concat_arrays(lots)

    return documents.withColumn(coded, run(F.col(text).cast("binary")))


def verified(documents: DataFrame, pieces: Pieces) -> DataFrame:
    """``documents`` with ids, after decoding has given back every text; a text that differs is an error."""
    coded = _free(documents, "coded")
    rows = _checked(documents, pieces, coded)
    wrong = F.raise_error(F.lit("decoding does not give the text back"))
    same = F.coalesce(F.col(coded)["same"], F.lit(True))
    return rows.withColumn("ids", F.when(same, F.col(coded)["ids"]).otherwise(wrong)).drop(coded)


def _free(documents: DataFrame, name: str) -> str:
    while name in documents.columns:
        name = "_" + name
    return name


def round_trip(documents: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_ids, ids and whether decoding gives the text back (null where the text is null)."""
    coded = _checked(documents.select("doc_id", "text"), pieces, "coded")
    ids = F.col("coded")["ids"]
    return coded.select(
        "doc_id", F.size(ids).cast("long").alias("n_ids"), ids.alias("ids"), F.col("coded")["same"].alias("same")
    )
