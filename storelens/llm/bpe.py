"""Byte-level BPE by a traversal of the trie of distinct words, and its inverse."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import small_batches, utf8

#: Fixed value: how the byte-level pre-tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_FILE_BYTES = 64 << 20
#: Words and token pairs a worker remembers; beyond, it starts anew.
CACHED_WORDS, CACHED_PAIRS = 600_000, 1_000_000
NEVER = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else the next from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the encoder's remembered words.

    The last token of a prefix's encoding is the one token that ends the prefix, follows on the last
    token before it, and leaves both unmerged (``follows``). So a word's encoding comes from the
    encodings of its prefixes, and words with a common prefix share them.
    """

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if data.get("normalizer") or odd or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        symbols = byte_symbols()
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens", [])):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.merged, self.rank, self.parts = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = model["vocab"][x], model["vocab"][y], model["vocab"][x + y]
            self.merged[a, b] = rank
            self.rank[c], self.parts[c] = rank, (a, b)
        self.token = {v: i for i, v in self.bytes_of.items() if i in self.rank or len(v) == 1}
        self.longest = max(map(len, self.token))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words_of = regex.compile(PATTERN)
        # Two generations each: when the newer is full, it becomes the older.
        self.spaced: list[dict[str, bytes]] = [{}, {}]
        self.bare: list[dict[str, bytes]] = [{}, {}]
        self.pairs: dict[tuple[int, int], bool] = {}

    def follows(self, u: int, v: int) -> bool:
        """Whether u and v side by side stay as they are.

        Read backwards, the merges take u apart at its right end and v at its left end, the later merge
        first. The two symbols that meet there at some time must not have been merged before either
        became part of something larger. Of equal merges the left one comes first.
        """
        if (known := self.pairs.get((u, v))) is not None:
            return known
        rank, a, b, a_until, b_until, fine = self.rank, u, v, NEVER, NEVER, True
        while True:
            at = self.merged.get((a, b))
            if at is not None and at < a_until and at <= b_until:
                fine = False
                break
            a_from, b_from = rank.get(a, -1), rank.get(b, -1)
            if a_from < 0 and b_from < 0:
                break
            if a_from > b_from:
                a_until, a = a_from, self.parts[a][1]
            else:
                b_until, b = b_from, self.parts[b][0]
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[u, v] = fine
        return fine

    def traverse(self, words: list[bytes]) -> Iterator[bytes]:
        """Encodings of sorted distinct words, as little-endian 32-bit ids.

        Sorted words are their trie in depth-first order: what two neighbours share is the path that
        stays, with the last token at each of its depths; only what differs is computed.
        """
        last: list[int] = [-1]
        token, follows = self.token, self.follows
        before = b""
        for word in words:
            depth = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                for start in range(max(0, end - self.longest), end):
                    t = token.get(word[start:end])
                    if t is not None and (follows(last[start], t) if start else True):
                        last.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= len(self.bytes_of[last[end]])
            yield b"".join(i.to_bytes(4, "little") for i in reversed(ids))
            before = word

    def _pieces(self, texts: set[str]) -> dict[str, bytes]:
        """Encodings of distinct short texts: cut into words, whose trie is traversed once."""
        cut = {t: self.words_of.findall(t) for t in texts}
        order = sorted({(w.encode(), w) for words in cut.values() for w in words})
        ids = dict(zip((w for _, w in order), self.traverse([b for b, _ in order]), strict=True))
        return {t: b"".join(map(ids.__getitem__, words)) for t, words in cut.items()}

    def _learn(self, spaced: set[str], bare: set[str]) -> None:
        for held, texts, lead in ((self.spaced, spaced, " "), (self.bare, bare, "")):
            new = texts.difference(held[0])
            if not new:
                continue
            if len(held[0]) + len(new) > CACHED_WORDS:
                held[0], held[1] = {}, held[0]
                new = texts
            again = {t: held[1][t] for t in new if t in held[1]}
            held[0].update(again)
            found = self._pieces({lead + t for t in new if t not in again})
            held[0].update((t[len(lead) :], ids) for t, ids in found.items())

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Encodings of whole texts.

        A space between two other characters that aren't white space starts a new word, so texts are
        split there and what stands between two such spaces is encoded once and remembered.
        """
        plans, spaced, bare = [], set(), set()
        for text in texts:
            plan = []
            for part in _parts(text, self.specials):
                if part in self.special:
                    plan.append(self.special[part].to_bytes(4, "little"))
                elif _IRREGULAR.search(part):
                    plan.append(([], words := self.words_of.findall(part)))
                    bare.update(words)
                else:
                    first, *rest = part.split(" ")
                    plan.append((rest, [first]))
                    bare.add(first)
                    spaced.update(rest)
            plans.append(plan)
        self._learn(spaced, bare)
        after, alone = self.spaced[0].__getitem__, self.bare[0].__getitem__
        return [
            b"".join(x if isinstance(x, bytes) else b"".join(map(alone, x[1])) + b"".join(map(after, x[0])) for x in plan) for plan in plans
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        held = memoryview(ids).cast("I") if sys.byteorder == "little" else [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)]
        return b"".join(map(self.bytes_of.__getitem__, held)).decode("utf-8", "replace")


#: A space beside other white space: there a word may start elsewhere.
_IRREGULAR = re.compile(r"\s | \s|^ $")
PART = 1 << 20


def _parts(text: str, specials) -> Iterator[str]:
    """Strings of added tokens and what stands between them, long parts cut before a space inside the text."""
    at, ends = 0, []
    if specials is not None and specials.search(text):
        for m in specials.finditer(text):
            ends += [m.start(), m.end()]
    for end in [*ends, len(text)]:
        while end - at > PART:
            cut = text.rfind(" ", at + 1, at + PART)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        if end > at:
            yield text[at:end]
        at = end


def grouped(texts: list[str], size: int = PART) -> Iterator[list[str]]:
    """Texts in groups of about ``size`` characters."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _loaded(content: str) -> Vocabulary:
    """The worker's vocabulary, which keeps what it remembers from task to task."""
    held = sys.modules["__main__"].__dict__.setdefault("_byte_level_vocabularies", {})
    if content not in held:
        held.clear()
        held[content] = Vocabulary(content)
    return held[content]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text decoded from them: (doc_id, ids, decoded).

    ids is a binary of little-endian unsigned 32-bit integers. Words are cut as the byte-level
    pre-tokenizer does; strings of added tokens become their ids. The vocabulary file is read on the
    driver, checked to be at most 64 MB, and sent to the workers, which encode per Arrow batch: the
    distinct words they don't remember are encoded in one traversal of their trie. No rows are shuffled.

    Null and empty texts have no ids and decode to an empty text. Rows that repeat each get a row; a null
    doc_id stays null. Very long texts are encoded in groups of words. Other columns are ignored.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError("the vocabulary file is too large to be sent to every worker")
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        vocabulary = _loaded(sent.value)
        for batch in batches:
            texts = [(text or b"").decode() for text in utf8(batch.column(1))]
            ids = [x for group in grouped(texts) for x in vocabulary.encode_many(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(vocabulary.decode, ids), pa.string())], ["doc_id", "ids", "decoded"]
            )

    held = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Per document the number of tokens and the SHA-256 of ids and decoded text."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
