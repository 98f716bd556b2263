"""Markdown from plain text, as Columns: a document is one string, its lines one array, and no row is shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import textrules as t
from .arrays import let, running


@dataclass(frozen=True)
class MarkdownOptions:
    """What to recognise and to clean; base_font_size: None works it out for each document."""

    detect_headers: bool = True
    detect_lists: bool = True
    detect_code: bool = True
    base_font_size: float | None = None
    remove_page_numbers: bool = True
    format_urls: bool = True
    fix_hyphenation: bool = True
    detect_bold: bool = True
    detect_italic: bool = True
    include_images: bool = True
    include_links: bool = True


def lines(text: Column) -> Column:
    """array<string>: lines without their ends; a last, empty one isn't a line."""
    bare = lambda x: F.when(x.contains("\r"), F.regexp_replace(x, r"\r$", "")).otherwise(x)

    def of(whole: Column) -> Column:
        cut = F.split(whole, "\n", -1)
        return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.transform(F.when(whole.endswith("\n"), let(cut, lambda c: F.slice(c, 1, F.size(c) - 1))).otherwise(cut), bare))

    return let(text, of)


def line_class(line: Column, options: MarkdownOptions = MarkdownOptions()) -> Column:
    """b (blank), l (list item), c (code) or t (text) of a trimmed line."""
    out = F.when(line == "", "b")
    if options.detect_lists:
        out = out.when(t.is_list_item(line), "l")
    if options.detect_code:
        out = out.when(t.is_code_like(line), "c")
    return out.otherwise("t")


def to_markdown(text: Column, options: MarkdownOptions = MarkdownOptions()) -> Column:
    """Lists get "- ", runs of code lines a fence; a list item within a run leaves the fence open."""

    def build(trimmed: Column) -> Column:
        def shown(classes: Column) -> Column:
            # Before each line: the class of the last line that is no list item, which hands the state on.
            over = lambda s, k: F.when(k == "l", s).otherwise(k)
            last = F.aggregate(classes, F.lit("n"), over)

            def pieces(states: Column) -> Column:
                def one(line: Column, i: Column) -> Column:
                    k, fenced = F.get(classes, i), F.get(states, i) == "c"
                    fence = F.when((k != "l") & (fenced != (k == "c")), "```\n").otherwise("")
                    return F.concat(fence, F.when(k == "l", t.format_list_item(line)).otherwise(line), F.lit("\n"))

                return F.array_join(F.transform(trimmed, one), "")

            return F.concat(let(running(classes, F.lit("n"), F.lit("l"), over), pieces), F.when(last == "c", "```\n").otherwise(""))

        return let(F.transform(trimmed, lambda x: line_class(x, options)), shown)

    return let(F.transform(lines(text), t.trim), build)


def remove_page_numbers(text: Column) -> Column:
    """Without page-number lines that stand between blanks, rules ("---") or ends, or before a rule."""

    def keep(all_lines: Column) -> Column:
        def kept(trimmed: Column) -> Column:
            n = F.size(trimmed)
            at = lambda i: F.get(trimmed, i)

            def stays(_: Column, i: Column) -> Column:
                edge = lambda j: at(j).isin("", "---")
                isolated = ((i == 0) | edge(i - 1)) & ((i + 1 == n) | edge(i + 1))
                before = (at(i + 1) == "---") | ((at(i + 1) == "") & (at(i + 2) == "---"))
                # The cheap tests first: most lines stand in text, and page numbers have digits or begin with "page".
                likely = at(i).rlike("[0-9]") | F.lower(at(i)).startswith("page")
                return ~((F.coalesce(isolated, F.lit(False)) | F.coalesce(before, F.lit(False))) & likely & t.is_page_number_line(at(i)))

            return F.array_join(F.filter(all_lines, stays), "\n")

        return let(F.transform(all_lines, t.trim), kept)

    return let(lines(text), keep)


def clean_markdown(text: Column, options: MarkdownOptions = MarkdownOptions()) -> Column:
    """Dot leaders, spaced hyphens, page numbers, URLs and blank lines put in order; one line break at the end."""
    out = t.collapse_dot_leaders(text)
    if options.fix_hyphenation:
        out = t.join_spaced_hyphens(out)
    if options.remove_page_numbers:
        out = remove_page_numbers(out)
    if options.format_urls:
        out = t.link_urls(out)
    return F.concat(t.trim(F.regexp_replace(out, "\n{3,}", "\n\n")), F.lit("\n"))
