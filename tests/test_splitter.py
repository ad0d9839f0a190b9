import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.operators import splitter as S
from inkmill.schemas import EngineError


def block(content, kind="paragraph", path=(), first=1, last=1, raw=""):
    return {"type": kind, "heading_path": list(path), "content": content, "raw_content": raw, "start_line": first, "end_line": last}


def contents(blocks, size, overlap):
    return [c["content"] for c in S.split(blocks, size, overlap)]


def lines(blocks, size, overlap=0):
    return [(c["start_line"], c["end_line"]) for c in S.split(blocks, size, overlap)]


@pytest.mark.parametrize("text,n", [("\u3000 \r", 0), ("Zq9?;,", 2), ("e" * 50, 15), ("+", 2), ("木x.~☂", 6), ("word word", 3)])
def test_weights(text, n):
    assert S.estimate(text) == n


def test_packing_ends_at_heading_changes():
    got = S.split([block("abcdefghij", path=["商品"], first=3, last=3), block("klmnopqrst", path=["商品"], first=5, last=5), block("颜色：黑色", path=["商品", "颜色"], first=8, last=8)], 16, 2)
    assert [(c["content"], c["start_line"], c["end_line"], c["chunk_index"]) for c in got] == [("abcdefghij\n\nklmnopqrst", 3, 5, 0), ("颜色：黑色", 8, 8, 1)]
    assert got[1]["heading_path"] == ["商品", "颜色"]


def test_headings_take_budget():
    path = "标题" * 100
    got = S.split([block("正文" * 150, path=[path])], 512, 0)
    assert len(got) >= 2 and all(S.estimate(f"{path}\n\n{c['content']}") <= 512 for c in got)


def test_overlap():
    got = S.split([block("abcdefghijklmnopqrst", path=["商品"]), block("small", path=["商品"], first=2, last=2), block("uvwxyzabcdefghijklmn", path=["商品"], first=3, last=3)], 11, 2)
    assert len(got) == 2 and got[1]["content"].startswith("small\n\n") and (got[1]["start_line"], got[1]["end_line"]) == (2, 3)
    got = contents([block("a" * 16), block("TAILuvwxyz"), block("n" * 16)], 8, 2)
    assert len(got) == 2 and got[1].startswith("TAILuvwxyz\n\n")
    assert contents([block("a" * 16), block("TAILuvwxyz"), block("n" * 20)], 8, 2)[1:] == ["n" * 20]
    got = contents([block("a" * 20), block("small"), block("n" * 26)], 8, 2)
    assert len(got) == 2 and "n" * 26 in got[1] and all(S.estimate(c) <= 8 for c in got)


def test_punctuation_and_sentences():
    got = contents([block("。" * 10)], 8, 2)
    assert len(got) == 2 and "\n\n" not in got[1] and all(S.estimate(c) <= 8 for c in got)
    text = "甲乙丙。丁戊己。🙂🙂🙂🙂🙂🙂"
    got = contents([block(text, path=["描述"])], 11, 0)
    assert got[:2] == ["甲乙丙。", "丁戊己。"] and "".join(got) == text
    assert contents([block("甲乙丙。丁戊己。", path=["描述"])], 11, 2)[1] == "丁戊己。"
    assert contents([block("first sentence. second sentence.")], 5, 0) == ["first sentence.", "second sentence."]


def test_the_last_window_is_cut_too():
    m = S.Meter()
    assert list(S.split_text("abc. def ghi", 20, m)) == ["abc.", "def", "ghi"]
    assert list(S.split_text("one two three four", 20, m)) == ["one two three", "four"]
    assert list(S.split_text("size 3.5 inch", 20, m)) == ["size 3.", "5", "inch"]


def test_any_estimator_scans_little():
    seen = 0

    def opaque(t):
        nonlocal seen
        seen += len(t)
        return S.estimate(t)

    got = S.split([block("a" * 65_536)], 64, 0, opaque)
    assert len(got) >= 2 and "".join(c["content"].replace("\n\n", "") for c in got) == "a" * 65_536
    assert seen <= 40 * 65_536


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。，汉$", max_size=120), st.integers(4, 30), st.integers(0, 3))
def test_estimators_agree_and_nothing_is_lost(text, size, overlap):
    plain = S.split([block(text)], size, overlap)
    assert plain == S.split([block(text)], size, overlap, S.estimate)
    if overlap == 0:
        assert re.sub(r"\s", "", "".join(c["content"] for c in plain)) == re.sub(r"\s", "", text)
    assert [c["chunk_index"] for c in plain] == list(range(len(plain)))


def test_tables():
    content = "| 规格 | 值 |\n| --- | --- |\n| a | 1 |\n| b | 2 |"
    got = S.split([block(content, "table", first=10, last=13, raw="x")], 12, 0)
    assert [c["content"].split("\n")[2:] for c in got] == [["| a | 1 |"], ["| b | 2 |"]]
    assert all(c["content"].startswith("| 规格 | 值 |\n| --- | --- |\n") for c in got)
    assert [(c["start_line"], c["end_line"]) for c in got] == [(10, 12), (10, 13)]


def test_lists():
    content = "- " + "甲" * 7 + "\n- " + "乙" * 7
    assert lines([block(content, "list", first=2, last=3, raw=content)], 12) == [(2, 2), (3, 3)]
    raw = "- " + "甲" * 7 + "\n\n- " + "乙" * 7 + "\n  more"
    assert lines([block(content, "list", first=2, last=5, raw=raw)], 12) == [(2, 2), (4, 5)]
    assert lines([block(content, "list", first=2, last=5, raw="- one")], 12) == [(2, 5), (2, 5)]
    assert contents([block("text first\n" + content, "list")], 12, 0) == ["text first\n" + content]


def test_code():
    content = "甲乙丙丁\n戊己庚辛"
    assert lines([block(content, "code", first=7, last=10, raw=f"```\n{content}\n```")], 8) == [(8, 8), (9, 9)]
    assert lines([block(content, "code", first=7, last=9, raw=f"```\n{content}")], 8) == [(8, 8), (9, 9)]
    got = contents([block("\n\n甲乙丙丁戊己\n庚辛", "code", last=4)], 8, 0)
    assert got[0] == "\n\n甲乙丙丁戊己" and len(got) == 2


@pytest.mark.parametrize("size,overlap", [(0, 0), (8, -1), (8, 8), (8, 9)])
def test_bad_settings(size, overlap):
    with pytest.raises(EngineError):
        S.split([block("x")], size, overlap)


def test_large_paragraph_is_linear():
    got = S.split([block("word " * 200_000)], 512, 64)
    assert len(got) > 300
