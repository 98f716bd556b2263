from pagewright.layout.lines import columns, group_into_lines, is_chaotic
from pagewright.layout.spacing import Item


def it(text, x, y, width=None, size=12.0, page=1, **kw):
    return Item(text, x, y, len(text.encode()) * size * 0.5 if width is None else width, size, "Helvetica", size, page, **kw)


def texts(items, **kw):
    return [line.text(**kw) for line in group_into_lines(items)]


def test_lines_and_spacing():
    assert texts([it("Hello", 100, 700, 50), it("World", 160, 700, 50), it("Next line", 100, 680)]) == ["Hello World", "Next line"]
    assert texts([it("the", 100, 500, 19.5), it("Prague", 119.5, 500, 42), it("Rules", 161.5, 500, 35)]) == ["the Prague Rules"]
    assert texts([it(c, 100 + 8 * k, 500, 8) for k, c in enumerate("NAV")]) == ["NAV"]
    assert texts([it("である", 100, 500, 24), it("履行義務", 124, 500, 32), it("を識別す", 156, 500, 32)]) == ["である履行義務を識別す"]
    assert texts([it("Third", 200, 700), it("First", 50, 700), it("Second", 100, 700)]) == ["First Second Third"]
    assert texts([it("a", 100, 700, page=2), it("b", 100, 700, page=1)]) == ["b", "a"]
    assert texts([]) == [] and texts([it("7", 300, 50), it("x", 100, 400)]) == ["x"]


def test_anchor():
    """Lines drift by no more than three points from their first item, not from the last."""
    assert [len(line.items) for line in group_into_lines([it("a", 50 + 60 * k, 500 - 2 * k) for k in range(4)])] == [2, 2]


def test_bold_and_italic():
    items = [it("plain", 50, 500), it("bold", 100, 500, is_bold=True), it("both", 150, 500, is_bold=True, is_italic=True), it("end", 200, 500)]
    assert texts(items, bold=True, italic=True) == ["plain **bold *both*** end"]
    assert texts(items, bold=True) == ["plain **bold both** end"]


def two_columns():
    left = [it(f"left {k}", 72, 700 - 14 * k, 180) for k in range(22)]
    right = [it(f"right {k}", 330, 700 - 14 * k, 180) for k in range(22)]
    return left, right


def test_columns_and_sections():
    left, right = two_columns()
    assert len(columns(left + right)) == 2 and len(columns(left)) == 1
    mixed = [x for pair in zip(left, right, strict=True) for x in pair]
    assert texts(mixed) == [i.text for i in left + right]
    wide = it("a wide heading", 72, 607, 440)
    got = texts([*mixed, wide])
    assert got == [i.text for i in left if i.y >= 607] + [i.text for i in right if i.y >= 607] + ["a wide heading"] + [i.text for i in left if i.y < 607] + [i.text for i in right if i.y < 607]


def test_chaos():
    up = [it(str(k), 50, 100 + (k % 2) * 300 + k) for k in range(8)]
    assert is_chaotic(up) and not is_chaotic(up[:4])
    assert not is_chaotic([it("a", 50, 700 - 60 * k) for k in range(8)])


from pagewright.layout.tables import clean_cells, detect_tables, merge_continuations, strict_regions, table_to_markdown  # noqa: E402


def grid(xs, ys, size):
    return [Item(f"{10 * r + c}.5" if c else f"Row{r}", x, y, 10, size, "F1", size) for r, y in enumerate(ys) for c, x in enumerate(xs)]


def test_tables():
    (t,) = detect_tables(grid([100, 200, 280, 360], [500, 480, 460, 440], 8), 10)
    assert len(t.columns) == 4 and len(t.rows) == 4 and len(t.items) == 16
    (t,) = detect_tables(grid([100, 200, 300, 400], [500, 480, 460, 440], 10), 10)
    assert len(t.columns) == 4 and len(t.rows) >= 3
    (t,) = detect_tables(grid([100, 200, 300], [700 - 12 * k for k in range(50)], 8), 10)
    assert len(t.rows) >= 40
    (t,) = detect_tables(grid([100, 200, 300], [700 - 10 * k for k in range(8)], 8), 12)
    assert len(t.rows) == 8
    assert detect_tables([Item("A line of a paragraph", 72, 700 - 14 * k, 400, 10, "F1", 10) for k in range(10)], 10) == []
    words = [Item("word", 72 + 37 * (k % 7) + 9 * (k // 7), 700 - 14 * (k // 7), 30, 10, "F1", 10) for k in range(27)]
    assert detect_tables(words, 10) == [] or strict_regions(words)


def test_table_markdown():
    assert table_to_markdown([["A", "Long"], ["1", "2"], ["", ""], ["", "more"], ["(1) note", ""]]) == "| A   | Long   |\n| --- | ------ |\n| 1   | 2 more |\n\n(1) note\n"
    assert clean_cells([["", "x"], ["a", ""]]) == ([["", "x"], ["a", ""]], [])
    md = "| A   |\n| --- |\n| 1   |\n"
    got = merge_continuations({1: [(700, md)], 2: [(700, md.replace("1 ", "2 "))], 4: [(700, md)]}, {2, 4})
    assert set(got) == {1, 4} and got[1][0][1].endswith("| 1   |\n| 2   |\n")


def test_cells():
    small = Item("2", 106, 502, 3, 6, "F1", 6.0)
    cell = lambda *items: cell_text(list(items))
    word = lambda text, x: Item(text, x, 500, 5, 8, "F1", 8.0)
    assert cell(word("12", 100), word("34", 105)) == "12 34"
    assert cell(word("a-", 100), word("b", 110)) == "a-b" and cell(word("a", 100), word("-b", 110)) == "a-b"
    assert cell(word("m", 100), small) == "m2" and cell(word("m", 100), word(" ", 103), word("n", 106)) == "m n" and cell() == ""


def test_rules_of_tables():
    assert is_consistent([["", ""]] * 3 + [["a", "b"]]) and not is_consistent([["a"] * 8, ["a"] * 4 + [""] * 4, ["a"] + [""] * 7])
    assert not has_data([["a"] * 5, [""] * 5], SMALL) and has_data([["a"] * 5, ["word"] * 5], SMALL) and not has_data([["a"] * 5, ["word"] * 5], BODY)
    assert clean_cells([["a", "b"], ["", "(1) x"], ["(2) y", "z"]]) == ([["a", "b (1) x"]], ["(2) y z"])


from pagewright.layout.tables import BODY, SMALL, cell_text, has_data, is_consistent  # noqa: E402
