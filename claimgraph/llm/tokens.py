"""Operators 4 and 10: token counts, and SentencePiece encoding and decoding with a streaming Viterbi search.

Both cut a text where no piece of the model can reach across: a boundary between two characters that stand
next to each other in no piece. What lies between such boundaries, a pre-token, has the same ids
wherever it stands. The rule is checked against the model when it is loaded.

Cases for both: a null text counts as empty; empty texts have no tokens; texts and pre-tokens may
be of any length (only short pre-tokens are remembered); repeated rows give repeated rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Longest pre-token remembered, and how many are remembered by a task's worker.
REMEMBER_CHARS, REMEMBER = 48, 600_000


class Pieces:
    """A SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        n = lib.get_piece_size()
        if lib.encode("ﬁ  A", out_type=str)[:1] != [SPACE] and "ﬁ" in lib.decode(lib.encode("ﬁ")):
            raise ValueError("the model normalises its input; pre-tokens could not be cut from the text")
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        self.surface = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(s[3:5], 16)]) if lib.is_byte(i) else b"" if special[i] else s.replace(SPACE, " ").encode() for i, s in enumerate(self.surface)]
        self.byte_id = {b[0]: i for i, b in enumerate(self.bytes) if lib.is_byte(i)}
        self.vocabulary = {s: i for i, s in enumerate(self.surface) if not special[i]}
        self.score = [lib.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.vocabulary))
        self.suffix: dict[str, int] = {}  # each suffix of a piece: the piece's id if it is one, else -1
        for s in self.vocabulary:
            for k in range(1, len(s)):
                self.suffix.setdefault(s[k:], -1)
        self.suffix |= self.vocabulary
        self.open = {s[:k] for s in self.vocabulary for k in range(1, len(s))}  # what a longer piece starts with
        self.pattern = self._pattern()
        self.pairs: dict[int, bool] = {}
        self.counts: dict[str, int] = {}
        self.ids = _Memory(self._ids)

    def _pattern(self) -> re.Pattern:
        touching = {(a, b) for s in self.vocabulary for a, b in zip(s, s[1:])}
        letters = {c for pair in touching for c in pair if unicodedata.category(c)[0] in "LM"}

        def kind(c: str) -> str:
            return "space" if c == SPACE else "letter" if c in letters else "digit" if re.match(r"\d", c) else "other"

        for a, b in touching:
            x, y = kind(a), kind(b)
            if "digit" in (x, y) or (y == "space" != x) or (x != "space" and x != y):
                raise ValueError(f"a piece reaches over the boundary between {a!r} and {b!r}")
        inside = "".join(map(re.escape, sorted(letters)))
        return re.compile(rf" *[{inside}]+| *[^{inside}\d ]+| +|\d")

    def pre_tokens(self, text: str) -> list[str]:
        """The text's pre-tokens; the blank that the model puts before a text is part of the first."""
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text: frequencies of its pre-tokens, joined to the pieces of each distinct one."""
        out = []
        for low in range(0, len(texts), 128):
            frequencies = [Counter(self.pre_tokens(t)) for t in texts[low : low + 128]]
            if len(self.counts) > REMEMBER:
                self.counts.clear()
            new = list(set().union(*frequencies).difference(self.counts))
            # a blank and the line end come before each
            of = self.counts
            of.update(zip(new, (len(ids) - 2 for ids in self.library.encode(["\n" + part for part in new], num_threads=1))))
            out += [sum([of[part] * n for part, n in f.items()]) for f in frequencies]
            for part in new:
                if len(part) > REMEMBER_CHARS:
                    del of[part]
        return out

    def _pair_ok(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces by score ends in just these two pieces."""
        parts, cut = list(self.surface[a] + self.surface[b]), len(self.surface[a])
        while True:
            best, at, where = None, -1, 0
            for i in range(len(parts) - 1):
                k = self.vocabulary.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return len(parts) == 2
            where = sum(map(len, parts[: at + 1]))
            if where == cut:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of text chunks (blanks as the model's blank mark), in bounded memory.

        A state is a boundary; its backpointer is the piece that ends there. A piece may follow another
        if merging both by score leaves both as they are; so each boundary keeps one backpointer, and
        the path through them is the one that the merges would give. A path survives while its boundary may still start a piece
        that goes on: what stands behind it begins some longer piece. Whenever all surviving paths have come together in one
        boundary, the ids up to it are final and are sent out. The window kept is a few times the longest piece.
        """
        ids: list[int] = [-1]  # of the piece that ends at each boundary kept; below -1: a character without a piece
        back: list[int] = [0]  # where it starts
        kept = ""  # the characters between the boundaries kept
        longest, suffix, pairs, open_ = self.longest, self.suffix, self.pairs, self.open
        alive: list[int] = [0]  # boundaries behind which some piece has begun
        for chunk in chunks:
            for char in chunk:
                kept += char
                end = len(kept)
                found = start = None
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    k = suffix.get(kept[start:end])
                    if k is None:
                        break
                    if k < 0:
                        continue
                    before = ids[start]
                    if before < 0:
                        found = k
                        break
                    ok = pairs.get(before << 20 | k)
                    if ok is None:
                        if len(pairs) > 1_000_000:
                            pairs.clear()
                        ok = pairs[before << 20 | k] = self._pair_ok(before, k)
                    if ok:
                        found = k
                        break
                if found is None:
                    found, start = -2 - ord(char), end - 1
                ids.append(found)
                back.append(start)
                alive = [s for s in alive if kept[s:end] in open_]
                final = end if not alive else self._meeting(back, [*alive, end]) if end >= longest else 0
                alive.append(end)
                if final:
                    yield from self._path(ids, back, final)
                    # a path that starts anew at the boundary has its last piece behind it
                    kept, ids, back = kept[final:], ids[final:], [max(0, b - final) for b in back[final:]]
                    alive = [s - final for s in alive]
        yield from self._path(ids, back, len(kept))

    @staticmethod
    def _meeting(back: list[int], paths: list[int]) -> int:
        """The last boundary that all paths go through."""
        now = set(paths)
        while len(now) > 1:
            top = max(now)
            now.remove(top)
            now.add(back[top])
        return now.pop()

    def _path(self, ids: list[int], back: list[int], end: int) -> list[int]:
        path: list[int] = []
        while end > 0:
            k = ids[end]
            path += (k,) if k >= 0 else [self.byte_id[b] for b in reversed(chr(-2 - k).encode())]
            end = back[end]
        return path[::-1]

    def _ids(self, part: str) -> bytes:
        return np.fromiter(self.stream((part.replace(" ", SPACE),)), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.pre_tokens(text))), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: pieces' bytes behind each other, without the blank put before it."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Memory(dict):
    """Remembers a function of short pre-tokens; starts anew when full."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, part: str):
        value = self.of(part)
        if len(part) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[part] = value
        return value


_LOADED: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, read once by each Python worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver; its bytes go along with the tasks
        return docs.sparkSession.sparkContext.broadcast(f.read())


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Each task counts the pieces of a distinct pre-token once and joins them to its documents'
    pre-token frequencies in place; no ids are kept and nothing is shuffled.
    """
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = pa.array(pieces.count_batch(texts), pa.int64())
            size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), n_chars_back, round_trip.

    ``round_trip`` says that decoding the ids gives the text again (the model's blank mark, U+2581,
    counts as a blank, as the model itself has it).
    """
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = [pieces.encode(t) for t in texts]
                back = [pieces.decode(i.tolist()) for i in ids]
                lengths = np.array([len(i) for i in ids])
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                values = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, values),
                        pa.array([len(b) for b in back], pa.int64()),
                        pa.array([b == t.replace(SPACE, " ") for b, t in zip(back, texts)]),
                    ],
                    ["doc_id", "n_tokens", "ids", "n_chars_back", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, n_chars_back long, round_trip boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
