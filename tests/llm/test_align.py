"""Alignment of two tokenizers: products of sparse matrices, links, groups and corpus-wide counts against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnkit.llm import align, queries
from churnkit.llm.common import table
from tests.conftest import SF
from tests.llm.helpers import docs, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "a", "Hello, world!", "two  spaces\tand\n\nlines ", "né à ﬁ １２ ①", "日本語のテキスト", "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b",
         "😀 👩‍👩‍👧 é", "x" * 300, " lead", "trail ", "!!!!!!!! ....... 12345678901234", "zero\x00byte", " nbsp  em", "it's we'll I'd 's", "x\r\ny \r z",
         "ok " * 2000, "same text here", "same text here", "\x1c a \x85 b", "\nfirst line", "a \nfirst line\n b", "x \t y"]


def sparse(m):
    rows, columns = np.nonzero(m)
    return align.Rows(np.r_[0, np.cumsum(np.bincount(rows, minlength=m.shape[0]))], columns, m[rows, columns], m.shape[1])


@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None)
def test_products_of_rows(n, k, m, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 3, (n, k)), r.integers(0, 3, (k, m))
    found = sparse(a).times(sparse(b))
    dense = np.zeros((n, m), np.int64)
    dense[found.row_numbers(), found.columns] = found.values
    assert (dense == a @ b).all() and (sparse(a).transposed().row_numbers() == np.nonzero(a.T)[0]).all()


LENGTHS = st.lists(st.integers(1, 4), min_size=1, max_size=12)


@given(LENGTHS, LENGTHS)
@settings(max_examples=200, deadline=None)
def test_links_of_spans(a, b):
    n = max(sum(a), sum(b))
    a, b = a + [n - sum(a)] * (sum(a) < n), b + [n - sum(b)] * (sum(b) < n)
    span = lambda x: [(sum(x[:i]), sum(x[:i + 1])) for i in range(len(x))]
    sa, sb = span(a), span(b)
    found = align.align_tokens(np.array(a), np.array(b))
    pairs = lambda rows: list(zip(rows.row_numbers().tolist(), rows.columns.tolist(), rows.values.tolist()))
    assert pairs(found.links("overlap")) == [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(sa) for j, y in enumerate(sb) if min(x[1], y[1]) > max(x[0], y[0])]
    assert pairs(found.links("ends")) == [(i, j, 1) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[1] == y[1]]
    cuts = sorted({x[1] for x in sa} & {y[1] for y in sb})
    group = lambda x: sum(c < x[1] for c in cuts)
    assert pairs(found.links("group")) == [(i, j, 1) for i, x in enumerate(sa) for j, y in enumerate(sb) if group(x) == group(y)]


def expected(rows):
    """The contract by plain loops over whole texts."""
    own = align.codec(A, B)
    seen = []
    for doc_id, text in rows:
        full = (" " + (text or "")).encode()
        a = own.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = own.b.encode(text or "")
        if not text or b"".join(own.a_bytes.entries[i] for i in a) != full or b"".join(own.b_bytes.entries[i] for i in b) != full:
            a, b = [], []
        ends = [{int(e): k for k, e in enumerate(np.cumsum([len(t[i]) for i in ids]))} for ids, t in ((a, own.a_bytes.entries), (b, own.b_bytes.entries))]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups, links, i, j = [], [], 0, 0
        for c in cuts:
            p, q = ends[0][c], ends[1][c]
            groups.append(",".join(map(str, a[i:p + 1])) + "|" + ",".join(map(str, b[j:q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        seen.append((doc_id, len(a), len(b), ";".join(groups), links))
    n = Counter(x for r in seen for x in r[4])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return sorted(((d, a, b, len(x), len(x), sum(n[p] == most[p[1]] for p in x), sum(n[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for d, a, b, g, x in seen), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def odd_rows():
    return [*enumerate(TEXTS), (3, "a repeated id"), (None, "no id"), (50, words(20_000, 1)), (51, "one" * 20_000)]


def test_operator_on_odd_texts(spark, monkeypatch):
    assert rows_of(align.alignment_digests(docs(spark, odd_rows()), A, B)) == expected(odd_rows())


def test_cut_texts_are_aligned_as_whole_ones():
    own = align.Codec(A, B)
    assert own.cuts
    said = [t or "" for _, t in odd_rows()]
    cut = own.results(said) + own.results(said)
    own.cuts = False
    assert cut == own.results(said) * 2


def test_memo_keeps_two_halves(monkeypatch):
    monkeypatch.setattr(align, "MEMO_SIZE", 50)
    own, other = align.Codec(A, B), align.codec(A, B)
    said = [words(80, k, 200) for k in range(20)]
    assert [own.results([t])[0] for t in said] == other.results(said) and len(own.known) <= 50 + 80


@pytest.mark.parametrize("kind", align.KINDS)
def test_token_links(spark, kind):
    found = align.token_links(docs(spark, [(1, "Hello, world! né"), (2, "a▁b"), (3, None)]), A, B, kind).collect()
    own = align.codec(A, B)
    a, b, plain = own.aligned(*own.encode(["Hello, world! né"]))
    links = plain.links(kind)
    assert sorted(tuple(r) for r in found) == [(1, i, j, int(a[i]), int(b[j]), v) for i, j, v in zip(links.row_numbers().tolist(), links.columns.tolist(), links.values.tolist())]


def test_unknown_kind_and_empty_table(spark):
    with pytest.raises(ValueError, match="links are one of"):
        align.token_links(docs(spark, [(1, "x")]), A, B, "near")
    assert align.alignment_digests(docs(spark, []), A, B).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_token_alignment(spark, SF)) == expected(rows)
