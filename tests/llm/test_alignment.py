"""Alignment of two tokenizers against a plain version that works token by token."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
import numpy as np
import sentencepiece
import tokenizers

from twinsift.llm import alignment

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_of = {chr(b): b for b in plain}
        self.byte_of.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})

    def tokens(self, text):
        """Tokens of both as (id, bytes), or none."""
        if not text:
            return [], []
        a = [(i, bytes(self.byte_of[c] for c in self.a.id_to_token(i)))
             for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if all(b"".join(x for _, x in t) == raw for t in (a, b)) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = []
        for tokens in (a, b):
            at, out = 0, []
            for _, raw in tokens:
                at += len(raw)
                out.append(at)
            ends.append(out)
        cuts, out = sorted(set(ends[0]) & set(ends[1])), []
        a, b = ([(i, e) for (i, _), e in zip(t, end)] for t, end in zip((a, b), ends))
        for cut in cuts:
            group = ([], [])
            for tokens, ids in zip((a, b), group):
                while tokens and tokens[0][1] <= cut:
                    ids.append(tokens.pop(0)[0])
            out.append(group)
        return out


def expected(texts):
    plain = Plain()
    found = [plain.groups(t) for t in texts]
    count = Counter()
    for groups in found:
        count.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups in found:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        spelled = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), len(links),
                    sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else "", spelled))
    return out


def values(rows):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in rows)


ODD = [None, "", " ", "  two  spaces ", "▁ is a mark of B", "<|endoftext|> and <s></s><unk> <0x41>", "tab\tand\nline\r\n\r\n",
       "Ünïcödé \U0001f600\U0001f468‍\U0001f469‍\U0001f467 日本語テキスト العربية", "x" * 3000, "ab" * 2000, "=-" * 700, "\x00zero", "café",
       "'s't 'RE don't WON'T", "same text", "same text", "1234567890" * 40, " 　  spaces"]


@pytest.mark.parametrize("part_bytes", [1, 200, 1 << 20])
def test_odd_texts(spark, part_bytes):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(None, "no id", "x", "y", "z"), (3, ODD[3], "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, pairs string, _text string").repartition(3)
    got = alignment.align(docs, A, B, part_bytes=part_bytes, with_groups=True).collect()
    want = sorted((str(r[0]), *e) for r, e in zip(rows, expected([r[1] for r in rows])))
    assert values(got) == want


def test_documents(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    got = alignment.align(small_docs.repartition(5), A, B, part_bytes=30_000, with_groups=True).collect()
    assert values(got) == sorted((str(i), *e) for (i, _), e in zip(rows, expected([t for _, t in rows])))


def test_keep_and_nothing(spark, no_docs, odd_docs):
    assert alignment.align(no_docs, A, B).count() == 0
    got = alignment.align(odd_docs, A, B, keep=("doc_id", "kept", "_text"))
    assert got.columns[:3] == ["doc_id", "kept", "_text"] and got.count() == odd_docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.randoms())
def test_pointers_end_at_common_cuts(sizes, random):
    total = sum(sizes)
    ends_a = np.cumsum(sizes)
    ends_b = np.array(sorted({total, *random.sample(range(1, total + 1), random.randint(1, total))}))
    last = alignment.farthest(ends_a, ends_b)
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for ends, got in ((ends_a, last[:len(ends_a)]), (ends_b, last[len(ends_a):])):
        assert [ends_b[k - len(ends_a)] for k in got] == [min(c for c in common if c >= e) for e in ends.tolist()]
