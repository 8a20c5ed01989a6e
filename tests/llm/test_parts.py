import base64
import html
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tilspark.llm import arrays as A
from tilspark.llm import html_tree as H
from tilspark.llm import op6_token_counts as C
from tilspark.llm import op8_byte_bpe as B
from tilspark.llm import repeats as R
from tilspark.llm.fm_index import FMIndex, Matcher, _long_suffix_array, suffix_array
from tilspark.llm.spans import Cache, SpanTable

ALPHABET = [*" '\"'stmdrevl  \n\t\r é漢字1२½a​\U0001f600́x\x1c\x1f\x85 ", "<|endoftext|>", "'ll", "'re"]


def fuzz(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return B.ByteBPE(B.read_ranks(path), public_tokenizers.PATTERN)


def test_bpe_equals_the_library_and_round_trips(bpe):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = fuzz(4000) + ["a " * 5000, "z" * 3000]
    for i, j, buf, off in A.sliced(pa.array(texts), 1 << 14):
        ids, ioff = bpe.encode(buf, off)
        assert bpe.decode(ids, ioff)[0].tobytes() == buf.tobytes()
        assert [ids[a:b].tolist() for a, b in zip(ioff[:-1], ioff[1:])] == [lib.encode_ordinary(t) for t in texts[i:j]]


def test_minimal_perfect_hash(bpe):
    tokens = [base64.b64decode(x.split()[0]) for x in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")]
    assert sorted(bpe.mph.slot.tolist()) == list(range(len(tokens)))
    probe = tokens[:500] + [t + b"\xff\xfe" for t in tokens[:500]]
    off = np.concatenate([[0], np.cumsum([len(t) for t in probe])])
    buf = np.frombuffer(b"".join(probe), np.uint8)
    found = bpe.mph.find(buf, off[:-1], off[1:], A.span_hashes(buf, off[:-1], off[1:]))
    assert (found[:500] >= 0).all() and (found[500:] == -1).all()


def test_pretokens_of_one_hash_are_held_to_their_bytes(bpe, monkeypatch):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    own = B.ByteBPE(bpe.ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(A, "span_hashes", lambda buf, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    for texts in (["ab cd ef qqzz", "abcd efgh"], ["ba dc qqzz  fe", "x", "ab"]):
        buf, off = A.utf8(pa.array(texts))
        ids, ioff = own.encode(buf, off)
        assert [ids[a:b].tolist() for a, b in zip(ioff[:-1], ioff[1:])] == [lib.encode_ordinary(t) for t in texts]


def test_a_cache_stays_small_and_right(bpe):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    own = B.ByteBPE(bpe.ranks, public_tokenizers.PATTERN)
    own.cache = Cache(limit=20_000)
    rng = random.Random(8)
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("qxzjk", k=6)) for _ in range(60))]
        buf, off = A.utf8(pa.array(texts))
        assert own.encode(buf, off)[0].tolist() == lib.encode_ordinary(texts[0])
        assert own.cache.nbytes <= 20_000


def test_long_texts_are_cut_where_pretokens_begin(bpe):
    from tilspark.llm import pretoken

    rng = random.Random(6)
    text = "".join(rng.choices(ALPHABET[:-3], k=4000))
    whole, _ = A.utf8(pa.array([text]))
    want = pretoken.starts(whole, np.array([0, len(whole)])).tolist()
    for limit in (40, 300):
        cuts = pretoken.pieces(whole, limit)
        assert len(cuts) > 5
        got = [a + int(s) for a, b in zip(cuts[:-1], cuts[1:]) for s in pretoken.starts(whole[a:b], np.array([0, b - a]))]
        assert got == want


def test_a_text_of_several_parts_equals_the_library(bpe):
    from tokenizers import Tokenizer

    from tilspark.llm import pretoken

    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshr\u00e9\u6f22", k=rng.randint(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=900_000)) + " <|endoftext|>  end"
    assert len(text.encode()) > 4 * A.SLICE_BYTES
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    parts = list(pretoken.parts(pa.array([text])))
    assert len(parts) > 2 and [p[-1] for p in parts] == [False] * (len(parts) - 1) + [True]
    assert [i for _, _, buf, off, _ in parts for i in bpe.encode(buf, off)[0].tolist()] == lib.encode_ordinary(text)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = C.Counter(open(path, encoding="utf-8").read())
    want = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert counter.counts(pa.array(["a b", text, None]), SpanTable.empty()).tolist() == [2, want, 0]


def test_pieces_of_a_long_text_give_its_fragments(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choices(["ab", "cd", "efg", "h"], k=3000))
    buf, off = A.utf8(pa.array([text]))
    for unit in (R.byte_unit(40), R.word_unit(20)):
        windows = lambda found, u=unit: {(int(a) + k, int(h)) for _, at, size, anchor, _ in found for a, n, h in zip(at, size, anchor) for k in range(n - u.length + 1)}
        want = windows(R._chunks(unit, buf, off))
        with monkeypatch.context() as m:
            m.setattr(R, "SLICE_UNITS", 500)
            assert windows(R._chunks(unit, buf, off)) == want


def test_other_patterns_go_through_regex(bpe):
    other = B.ByteBPE(bpe.ranks, r"\s+|\S+")
    lib = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=bpe.ranks, special_tokens={})
    buf, off = A.utf8(pa.array(["a b  é", ""]))
    assert other.encode(buf, off)[0].tolist() == lib.encode_ordinary("a b  é")


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, lib = C.Counter(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = fuzz(4000) + [None]
    none = SpanTable.empty()
    got = [n for k in range(0, len(texts), 500) for n in counter.counts(pa.array(texts[k : k + 500], pa.string()), none).tolist()]
    assert got == [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def shard_text(rng, top=4):
    parts = [rng.integers(1, top, rng.integers(1, 40)) for _ in range(12)]
    return parts, np.concatenate([np.append(p, 0) for p in parts])


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        _, text = shard_text(rng)
        length, n = 5, len(text)
        order = suffix_array(text, length)
        index = FMIndex(text, order)
        real = [p for p in range(n - length + 1) if (text[p : p + length] > 0).all()]
        windows: dict[tuple, list[int]] = {}
        for p in real:
            windows.setdefault(tuple(text[p : p + length].tolist()), []).append(p)
        group = np.cumsum(index.lengths_below(length)[:n] >= 0)
        of = dict(zip(order.tolist(), group.tolist()))
        assert all((of[p] == of[q]) == (tuple(text[p : p + length]) == tuple(text[q : q + length])) for p in real for q in real[:30])
        i, j = np.zeros(len(real), np.int64), np.full(len(real), n)
        for k in range(length - 1, -1, -1):
            i, j = index.step(text[np.array(real) + k], i, j)
        assert (j - i).tolist() == [len(windows[tuple(text[p : p + length].tolist())]) for p in real]


def test_suffix_arrays_agree():
    rng = np.random.default_rng(4)
    for top in (3, 200):
        _, text = shard_text(rng, top)
        for depth in (1, 4, 9):
            cut = lambda order, d=depth: [tuple(text[p : p + d].tolist()) for p in order.tolist()]
            a, b = suffix_array(text, depth), _long_suffix_array(text, depth)
            assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(len(text)))
            assert cut(a) == cut(b) == sorted(cut(a))


def test_matching_statistics():
    rng = np.random.default_rng(7)
    for depth in (1, 3, 6):
        for _ in range(15):
            parts, text = shard_text(rng)
            owner = rng.integers(0, 6, len(parts))
            size = np.array([len(p) for p in parts])
            begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
            matcher = Matcher(text, np.repeat(owner, size + 1), depth)
            limit = owner + rng.integers(0, 2, len(parts))
            stream, at = matcher.matches(text, begin, begin + size, limit)
            held = {}
            for p, o in zip(parts, owner.tolist()):
                for k in range(len(p) - depth + 1):
                    w = tuple(p[k : k + depth].tolist())
                    held[w] = min(o, held.get(w, 9))
            want = {(s, int(b) + k) for s, (p, b, m) in enumerate(zip(parts, begin, limit)) for k in range(len(p) - depth + 1) if held[tuple(p[k : k + depth].tolist())] < m}
            assert set(zip(stream.tolist(), at.tolist())) == want and len(stream) == len(want)


def test_every_window_is_in_one_fragment_and_equal_windows_share_anchors():
    rng = np.random.default_rng(2)
    unit = R.byte_unit(40)
    texts = ["".join(rng.choice(list("ab"), 300)) for _ in range(3)] + ["ab" * 90, "short", ""]
    texts.append(texts[0][50:200])
    buf, off = A.utf8(pa.array(texts))
    anchors: dict[bytes, set] = {}
    seen = []
    for r, at, size, anchor, _ in zip(*R.fragments(unit, *R.windows(unit, buf, off))):
        for k in range(size - 39):
            seen.append((r, at + k))
            anchors.setdefault(texts[r].encode()[at + k : at + k + 40], set()).add(anchor)
    assert sorted(seen) == [(r, k) for r, t in enumerate(texts) for k in range(max(0, len(t) - 39))]
    assert all(len(a) == 1 for a in anchors.values())


PAGES = [
    # page, text, as read under its own best container
    ("<html><body><nav>Menu <a href=/>home</a></nav><article><h1>Big  title</h1><p>First &amp; best part of it all, long enough.<p>Second&nbsp;one<br>goes on</article><footer>foot</footer>", "Big title\nFirst & best part of it all, long enough.\nSecond one goes on"),
    ("<div class='header-1'>x</div><div class=content><div class='post-12'><p>Text one is here, and it is a long one.</p><ul><li>a point</li><li>another</li></ul></div><div id='comments'><p>I disagree with all of this, says a reader.</p></div></div>", "Text one is here, and it is a long one.\na point\nanother"),
    ("<article><p>Body text that is the article of this page.</p><aside>side</aside><form>f<input></form><script>var a='<p>no</p>'</script><style>p{}</style><p>More <b>bold</b><i> text</i> here</p><!-- <p>hidden</p> --></article>", "Body text that is the article of this page.\nMore bold text here"),
    ("<ARTICLE><P>Upper case marks are read just the same.</P><DIV CLASS='ad'>buy</DIV><TABLE><TR><TD>cell one<TD>cell two</TABLE></ARTICLE>", "Upper case marks are read just the same.\ncell one\ncell two"),
    ("<article><p>a &lt; b & c &#233; &#x41; &unknown; 1 < 2</p></article>", "a < b & c é A &unknown; 1 < 2"),
    ("plain words without any marks", "plain words without any marks"),
    ("", ""), ("<html></html>", ""), ("<p>cut off in a ta", "cut off in a ta"), ("<article><p>one</p><p></p><p> \n </p><p>two<a", "one\ntwo"),
]


def test_pages():
    for page, want in PAGES:
        text, _ = H.extract(H.parse(page), [])
        assert text == want, page


ARTICLE = "<article><h1>Title of it</h1><p>This is the article's long text, of some words, which is what is wanted.</p><p>And a second paragraph.</p></article>"
ARTICLE_TEXT = "Title of it\nThis is the article's long text, of some words, which is what is wanted.\nAnd a second paragraph."


@pytest.mark.parametrize("name", ["layout has-sidebar", "page with-comments", "single-post widget-area-none", "content promo-article", "no-ads", "comments", "main-menu-open"])
def test_an_element_around_the_article_stays_whatever_its_class(name):
    page = f"<body><nav>menu</nav><div class='{name}'>{ARTICLE}<div class='comments'><p>I disagree.</p></div></div><div class='sidebar'><p>beside it</p></div></body>"
    assert H.extract(H.parse(page), [])[0] == ARTICLE_TEXT
    assert H.extract(H.parse(f"<form id='page'><div>{ARTICLE}</div><div class='promo-article'>Buy.</div></form>"), [])[0] == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["user-reviews", "comments", "commentList", "feedback"])
def test_comments_longer_than_the_story_are_not_it(name):
    said = "".join(f"<article><p>I am reader {k}, and I write a long comment about this, longer than the story was.</p></article>" for k in range(3))
    page = f"<div class='story'><h1>Title of it</h1><p>This is the story, of some words.</p></div><div class='{name}'>{said}</div>"
    assert H.extract(H.parse(page), [])[0] == "Title of it\nThis is the story, of some words."


def test_long_paths_vote_too():
    page = "<body>" + "".join(f"<div class='level-{'x' * 40}-part{'abcdefghijklmnop'[k]}'>" for k in range(16)) + "<p>The text of this page, deep down in it.</p>"
    node, _ = H.score(H.parse(page))
    path = node.path()
    assert len(path) <= H.PATH_CHARS and H.extract(H.parse(page), [path]) == ("The text of this page, deep down in it.", path)


def test_host_paths_win_over_own_scores():
    page = "<body><div class='story-9'><p>The short story.</p></div><div class='links'><p>A long text in another container, which would win on its own here.</p></div></body>"
    assert H.extract(H.parse(page), ["div.story-#"]) == ("The short story.", "div.story-#")
    assert H.extract(H.parse(page), ["div.none"])[0].startswith("A long text")


def test_deep_and_wild_pages_do_not_break():
    rng = random.Random(4)
    parts = ["<div>", "</div>", "<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<script>", "</script>", "<!--", "-->", "text ", "&amp", "<", ">", '"', "<a href='", "<svg>", "<body>", "<head>", "</head>"]
    for _ in range(300):
        H.extract(H.parse("".join(rng.choices(parts, k=60))), ["div"])
    deep = "<div>" * 3000 + "core of the page" + "</div>" * 3000
    assert H.extract(H.parse(deep), [])[0] == "core of the page"
    assert html.unescape("&amp;") == "&"


def test_bitmaps_lose_no_link_between_sets_of_any_size():
    from tilspark.llm import op2_jaccard_join as J

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 240, 260, 300, 900, 1100)]
    sets = [b[: max(1, int(len(b) * k))] for b in base for k in (1, 0.97, 0.8, 0.5)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = J.bitmaps(np.concatenate(sets), off)
    assert len({len(b) for b in bits}) > 2
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    want = [any(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = J.may_link(np.diff(off), bits, 80)
    assert all(g or not w for g, w in zip(got, want)) and got.sum() < len(sets)
