"""Cross-tokenizer alignment against whole-text encoding and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from messy_fixtures import messy, messy_rows, nothing  # noqa: F401
from tokenizers import Tokenizer

from cohortline.llm import token_alignment
from cohortline.llm.token_alignment import FOLDER, align_documents, read_tokenizers, settled_ends, token_groups

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "a", " ", "  two  blanks ", "line\nnext\r\n\n  tab\tend ", "<|endoftext|> <s> <0x41> </s>", "中文字符 测试　全角 한국어 ไทย", "\U0001f600\U0001f468‍\U0001f469 é é ﬁ",
    "has ▁ blank sign", "x▁", "zero\x00byte \x1f\x85\xa0", "don't we'll I'VE 12345 3.14", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "\n", "the the the cat", "the the the cat", "wörter " * 50,
    "a b ​ c", "()[]{}!!!??? ==== ----", "Ω≈ç√∫˜µ≤", "퟿\U0010ffff",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    alphabet = token_alignment.byte_alphabet()

    def groups(text):
        """Of one whole text: lists of A and B ids, or None."""
        if not text:
            return None
        one = a.encode(" " + text, add_special_tokens=False)
        two, ids = b.encode(text), one.ids
        left = [bytes(alphabet[c] for c in t) for t in one.tokens]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in two for p in [b.id_to_piece(i)]]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return None
        x, y = np.cumsum([len(t) for t in left]).tolist(), np.cumsum([len(t) for t in right]).tolist()
        out, i, j = [], 0, 0
        for cut in sorted(set(x) & set(y)):
            k, n = x.index(cut, i) + 1, y.index(cut, j) + 1
            out.append((ids[i:k], two[j:n]))
            i, j = k, n
        return out

    return groups


def expected(texts, groups):
    found = [groups(t) for t in texts]
    held = Counter(pair for own in found if own for pair in {(x, y) for a, b in own for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for own in found:
        if not own:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in own for x in a for y in b]
        digest = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        best = sum(held[p] == most[p[0]] for p in links)
        out.append((sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), best, sum(held[p] for p in links), hashlib.sha256(digest.encode()).hexdigest()))
    return out


def rows(df, key="doc_id"):
    return Counter((r[key], *(r[c] for c in COLUMNS)) for r in df.collect())


def test_messy_rows(messy, messy_rows, plain):
    found = align_documents(messy, chunk_text=3000)
    want = expected([r[1] for r in messy_rows], plain)
    assert rows(found) == Counter((r[0], *w) for r, w in zip(messy_rows, want))
    assert [c for c in found.columns if c not in COLUMNS] == messy.columns


@pytest.mark.parametrize("chunk_text", [1, 200, 1 << 20])
def test_odd_characters(spark, plain, chunk_text):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    assert rows(align_documents(docs, chunk_text=chunk_text)) == Counter((i, *w) for i, w in enumerate(expected(TEXTS, plain)))


def test_table_of_the_driver(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    want = expected([t for _, t in texts], plain)
    assert rows(align_documents(docs)) == Counter((i, *w) for (i, _), w in zip(texts, want))


def test_groups_are_those_of_the_whole_text(spark, plain):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in token_groups(docs).collect():
        assert [(g["a"], g["b"]) for g in r["groups"]] == (plain(TEXTS[r["doc_id"]]) or [])


def test_store_may_be_emptied_at_any_time(spark, plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "STORED", 1)
    store = token_alignment._store.__wrapped__(read_tokenizers(spark))
    for text in TEXTS * 2:
        at, _ = store.of([text])
        own = ";".join(store.groups[i] for i in at) if all(store.facts[at, 0] == 1) else ""
        assert own == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(text) or [])


def test_token_messages_are_read_once(spark):
    tokenizers = token_alignment.Tokenizers(*read_tokenizers(spark).value)
    whole, reads = tokenizers.encoded([" one", " two words"]), []

    class Message:
        def __init__(self, message):
            self.message = message

        @property
        def pieces(self):
            reads.append(1)
            return self.message.pieces

    class Pieces:
        real = tokenizers.b

        def encode(self, *args, **kwargs):
            return list(map(Message, self.real.encode(*args, **kwargs)))

    tokenizers.b = Pieces()
    again = tokenizers.encoded([" one", " two words"])
    assert [[x.tolist() for x in t] for t in again] == [[x.tolist() for x in t] for t in whole]
    assert len(reads) == 2


def test_large_groups_count_their_links():
    a, b = np.arange(100) % 3, np.arange(90) % 2 + 5
    group, code, times = token_alignment._linked(a, b, np.array([100]), np.array([90]))
    assert times.sum() == 9000 and len(code) == 6 and set(group) == {0}
    assert dict(zip(code.tolist(), times.tolist())) == Counter((int(x) << 32) | int(y) for x in a for y in b)


def test_coarse_ends_are_refined_by_bytes():
    # Two tokens share a character of three bytes, and one follows.
    assert settled_ends(np.array([0, 1, 1, 4]), np.array([1, 4, 4, 5]), np.array([1, 2, 1, 1])).tolist() == [1, 3, 4, 5]


def test_empty_table(nothing):
    found = align_documents(nothing)
    assert found.count() == 0 and set(COLUMNS) <= set(found.columns)
