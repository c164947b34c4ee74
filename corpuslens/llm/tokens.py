"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpuslens.sources.tables import spread

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORDS_KEPT, _PAIRS_KEPT = 300_000, 1_000_000


class ByteBpe(dict):
    """Encodes words in linear time; the dict holds the ids of words met before.

    Bytes are mapped to Latin-1, and an automaton over all tokens finds every token that begins at each byte. From the left,
    the longest token goes first; it stands if the merges would leave it and the token before it side by side,
    else the next shorter one is tried, and when none is left the token before is taken back. Two neighbours
    are tried once and remembered. A sequence whose neighbours all stand is the one that the merges give.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.stands: dict[tuple[int, int], bool] = {}

    @classmethod
    def parse(cls, file: bytes, pattern: str = PATTERN) -> ByteBpe:
        return cls({base64.b64decode(t): int(i) for t, i in (line.split() for line in file.splitlines() if line)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """The merges as published: the pair of lowest rank first, the left one on a tie."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.stands.get((left, right))
        if known is None:
            if len(self.stands) > _PAIRS_KEPT:
                self.stands.clear()
            known = self.stands[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode_word(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        begin: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(data.decode("latin-1")):
            begin[end - match[0] + 1].append(match)  # ends come in order, so the longest is the last
        ids, at, dead = [], [0], bytearray(n + 1)
        tries = [len(begin[0]) - 1]  # of the token to choose at each place, the next to try
        while at[-1] < n:
            place, k = at[-1], tries[-1]
            while k >= 0:
                size, token = begin[place][k]
                if not dead[place + size] and (not ids or self.compatible(ids[-1], token)):
                    break
                k -= 1
            if k < 0:  # no way on from here
                dead[place] = 1
                at.pop()
                tries.pop()
                ids.pop()
                tries[-1] -= 1
                continue
            tries[-1] = k
            ids.append(token)
            at.append(place + size)
            if place + size < n:
                tries.append(len(begin[place + size]) - 1)
        return ids

    def __missing__(self, word: str) -> list[int]:
        ids = self.encode_word(word.encode())
        if len(word) < 64:
            if len(self) > _WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self.findall(text):
            ids += self[word]
        return ids


_built: dict[bytes, ByteBpe] = {}


def _encoder(shared) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    digest = hashlib.sha256(shared.value).digest()
    if digest not in _built:
        _built.clear()
        _built[digest] = ByteBpe.parse(shared.value)
    return _built[digest]


def _file(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:  # about a megabyte, whatever the corpus
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id, ids` of every row: the ids of its text, without special tokens, in order.

    Strings of special tokens in a text are ordinary text. Null and empty texts have the empty list. Rows are
    taken as they are: repeated rows come out repeated, a null doc_id stays null, an empty table gives no row.
    """
    shared = _file(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column("text").to_pylist():
                if text:
                    flat += bpe.encode(text)
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.selectExpr("cast(doc_id AS BIGINT) AS doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def with_token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`documents` with its texts replaced by n_tokens (0 for null and empty texts)."""
    shared = _file(documents, vocabulary)
    others = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared)
        for batch in batches:
            counts = [sum(len(bpe[w]) for w in bpe.findall(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(counts, pa.int64())], names=[*others, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")
    return spread(documents).mapInArrow(run, f"{fields}, n_tokens long")
