"""Cross-tokenizer alignment against brute force over single bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storelens.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE_OF = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
BYTE_OF |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in BYTE_OF)}


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) per row, from the owners of every byte."""
    theirs = Tokenizer.from_file(A)
    theirs.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    found, docs_of = [], Counter()
    for doc, text in rows:
        data = (" " + (text or "")).encode()
        a = theirs.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode([text or ""], num_threads=1)[0]
        a_bytes = [bytes(BYTE_OF[c] for c in theirs.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            found.append((doc, [], [], "", 0, []))
            continue
        owner = [[k for k, part in enumerate(parts) for _ in part] for parts in (a_bytes, b_bytes)]
        links = sorted(set(zip(*owner)))
        groups, i0, j0 = [], 0, 0
        for x in range(len(data)):
            ends = [x + 1 == len(data) or o[x + 1] != o[x] for o in owner]
            if all(ends):
                i, j = owner[0][x] + 1, owner[1][x] + 1
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                i0, j0 = i, j
        pairs = [(a[i], b[j]) for i, j in links]
        docs_of.update(set(pairs))
        found.append((doc, a, b, ";".join(groups), len(groups), pairs))
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    return Counter(
        (doc, len(a), len(b), n, len(pairs), sum(docs_of[p] == most[p[0]] for p in pairs), sum(docs_of[p] for p in pairs),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for doc, a, b, groups, n, pairs in found
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    letters = "aeiontrshl 'ABT.,-=0123\n\t\r éß漢字🙂 ²Ⅳ "
    texts = [None, "", " ", "a", "  a  b ", "<|endoftext|> <s></s>", "x<unk> <0x41>", "▁ under", "a▁b", "\x00z", "a" * 3000, " " * 2000 + "x", "It's we'll\n\n I'd", "tokenization of words " * 9000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(250)]
    texts += [" ".join(rng.choice(["the", "nation", "statement", "unbelievable", "Größe"]) for _ in range(60)) for _ in range(60)]
    return [*enumerate(texts), (None, "the nation"), (3, "again"), (3, "a")]


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 200, 1])
def test_alignment(spark, rows, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "pair": F.lit(1), "n": F.lit(2), "pairs": F.lit(3)}).repartition(3)
    found = align.counted(align.digests(align.align(docs, A, B, steps=1 << 15 if hot > 1 else 50)), hot)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect())
    assert got == brute(rows)
    assert align.counted(align.align(docs.limit(0), A, B)).count() == 0


def test_pieces_do_not_depend_on_each_other():
    rng = np.random.default_rng(5)
    for _ in range(60):
        last = int(rng.integers(1, 300))
        a, b = (np.append(np.sort(rng.choice(last, int(rng.integers(0, last)), replace=False) + 0), last) for _ in range(2))
        a, b = a[a > 0], b[b > 0]
        whole = align.merged(a, b, 10**6)
        links = set(zip(whole.i.tolist(), whole.j.tolist()))
        assert len(links) == len(whole.i) == len(np.union1d(a, b))
        for steps in (1, 2, 7, 40):
            at_a, at_b = align.diagonals(a, b, steps)
            assert np.all(np.diff(at_a + at_b)[:-1] == steps) and at_a[-1] == len(a) and at_b[-1] == len(b)
            part = align.merged(a, b, steps)
            assert set(zip(part.i.tolist(), part.j.tolist())) == links and len(part.i) == len(links)
            assert np.array_equal(part.group_a, whole.group_a) and np.array_equal(part.group_b, whole.group_b)
    assert len(align.merged(np.zeros(0, np.int64), np.zeros(0, np.int64)).i) == 0


def test_vocabularies_in_another_order_are_refused():
    with pytest.raises(ValueError):
        align.ByteLevel(b'{"model": {"vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, "merges": ["a b", "b c"]}}')
