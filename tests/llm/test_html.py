"""Rendering of random pages, whose lines are known when they are made, and of odd ones."""

import random
import re
import time

import pytest
from sparloom.llm import html


class Maker:
    """Random pages as (html, lines that are seen)."""

    def __init__(self, seed):
        self.rng, self.n = random.Random(seed), 0

    def word(self, shown=True):
        self.n += 1
        return f"{'w' if shown else 'hidden'}{self.n}"

    def hidden(self):
        w = self.word(False)
        return self.rng.choice([f"<span hidden>{w}</span>", f"<script>{w}</script>", f'<b style="color:red; display : none">{w}</b>', f"<i class='x gone'>{w}</i>", f"<!-- {w} -->", f"<template><p>{w}</p></template>", f"<em id=off>{w}</em>"])

    def inline(self):
        out, words = [], []
        for _ in range(self.rng.randrange(1, 5)):
            w = self.word()
            words.append(w)
            out.append(self.rng.choice([w, f"<b>{w}</b>", f"<a href='#'>{w}</a>", f"<span style='visibility:hidden'>{self.word(False)} <u style='visibility:visible'>{w}</u></span>", f"<I><font>{w}</font></I>"]))
            if self.rng.random() < 0.2:
                out.append(self.hidden())
        return self.rng.choice([" ", "\n", " \t "]).join(out), " ".join(words)

    def end(self, name):
        return self.rng.choice(["", f"</{name}>"])

    def listed(self, depth, level=0):
        ordered = self.rng.random() < 0.5
        out, lines = [], []
        for i in range(self.rng.randrange(1, 4)):
            page, text = self.inline()
            lines.append(f"{i + 1}. {text}" if ordered else f"- {text}")
            if depth and self.rng.random() < 0.3:
                inner, more = self.listed(depth - 1, level + 1)
                page, lines = page + inner, lines + more
            out.append(f"<li>{page}{self.end('li')}")
        name = "ol" if ordered else "ul"
        return f"<{name}>{''.join(out)}</{name}>", lines

    def table(self):
        width = self.rng.randrange(1, 4)
        rows = [[self.inline() for _ in range(width)] for _ in range(self.rng.randrange(1, 4))]
        loose, own = ("", "") if self.rng.random() < 0.7 else self.inline()
        page = "".join(f"<tr>{''.join(f'<td>{c}' + self.end('td') for c, _ in r)}{self.end('tr')}" for r in rows)
        return f"<table>{f'<div>{loose}</div>' if own else ''}{page}</table>", ([own] if own else []) + [" | ".join(t for _, t in r) for r in rows]

    def block(self, depth):
        kind = self.rng.randrange(6 if depth else 4)
        if kind == 0:
            page, text = self.inline()
            return f"<p>{page}{self.end('p')}", [text]
        if kind == 1:
            return self.table()
        if kind == 2:
            return self.listed(depth)
        if kind == 3:
            return f"<div hidden><p>{self.word(False)}</div>", []
        parts = [self.block(depth - 1) for _ in range(self.rng.randrange(1, 4))]
        name = self.rng.choice(["div", "section", "blockquote", "article"])
        return f"<{name}>{''.join(p for p, _ in parts)}</{name}>", [x for _, lines in parts for x in lines]

    def page(self):
        parts = [self.block(3) for _ in range(5)]
        style = "<style>/* x */ .gone, b.never { color: red; display:none } @media print { p, li, td { display: none } } #off{visibility:hidden}</style>"
        return f"{self.rng.choice(['', '<html>', '<!doctype html><html><head>'])}<title>T</title>{style}{''.join(p for p, _ in parts)}", [x for _, lines in parts for x in lines]


@pytest.mark.parametrize("seed", range(60))
def test_random_pages(seed):
    page, lines = Maker(seed).page()
    title, text = html.extract(page)
    assert title == "T" and [re.sub(" +", " ", x.strip()) for x in text.split("\n") if x.strip()] == lines


def test_visibility():
    text = lambda page: html.extract(page)[1].split()
    assert text("<p style='visibility:hidden'>no <b style='visibility:inherit'>no</b><b style='VISIBILITY: visible'>yes</b></p>") == ["yes"]
    assert text("<style>p{display:none} p.a{display:block} #i{display:none!important}</style><p>no<p class='a b'>yes<p class=a id=i style='display:block'>no") == ["yes"]
    assert text("<style>div > p {display:none}</style><div><p>yes</div>") == ["yes"]  # no compound selector
    assert text("<style>@import 'x'; .a{display:none}</style><b class=a>no</b><b hidden style='display:inline'>yes</b>") == ["yes"]


def test_cells_and_line_ends():
    extract = lambda page: html.extract(page)[1]
    assert extract("<table><tr><td>x |<td></table>") == "x |" and extract("<table><tr><td>|<td>b |</table>") == "| | b |"
    assert extract("<table><tr><td rowspan=70000>a<td>b<tr><td>c<tr><td>d</table>e") == "a | b\n  | c\n  | d\n\ne"
    assert extract("<pre>\n\na\n b</pre>") == "\na\n b" and extract("<input value=v> <input type=hidden value=no><input type=submit value=Go>") == "v Go"


def test_long_pages():
    assert html.extract("<p>" + "<b>a</b> " * 30_000)[1] == " ".join(["a"] * 30_000)
    assert len(html.extract("<table>" + "<tr><td rowspan=9 colspan=3>x" * 3000)[1].split("\n")) == 3000


def test_repeated_and_clashing_rows(spark):
    rows = spark.createDataFrame([(1, "<p>a", "t", "u"), (1, "<p>a", "t", "u"), (None, None, None, None)], "page_id long, html string, title string, text string")
    assert sorted((r["page_id"] or 0, r["title"], r["text"]) for r in html.extract_text(rows).collect()) == [(0, None, None), (1, "", "a"), (1, "", "a")]
    assert html.extract_text(rows.limit(0)).count() == 0


def test_tokens_are_read_forwards_by_states():
    cases = [
        ("<p title=Bob's>visible one</p> and two <p>it's three</p> four", "visible one\n\nand two\n\nit's three\n\nfour"),
        ("a < b <3 </ <> c", "a < b <3 c"),  # `</ ` begins a comment up to the next `>`
        ("x<!-->y<!--->z<!-- a > b -->w<!-- open", "xyzw"), ("one<!bogus>two<?php three>four</5>five", "onetwofourfive"),
        ('<a href="x>y" title=a/b>link</a>', "link"), ("<b title='never ends>lost", ""), ("shown <b title=x", "shown"), ("<p =a b=>kept</p>", "kept"),
        ("<svg><text><![CDATA[a < b]]></text></svg> <![CDATA[x]]>y", "a < b y"), ("<meter>low</meter><progress>half</progress><ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>", "xy"),
        ("<div style=\"content:';display:none;'\">seen</div><div style='content:\"a\";display:none'>not</div>", "seen"),
        ("<style>@media screen { .a { display: none } .b {visibility:hidden} } .c{display:none} @media print { p {display:none} } @media (max-width: 9px), all {.d{display:none}}</style><p class=a>1</p><p class=b>2</p><p class=c>3</p><p class=d>4</p><p>5", "5"),
        ("<style>@supports (x:y) { p {display:none} } .q::before { content: '} p {display:none'; }</style><p>in", "in"), ("<p hidden hidden=x>no</p><p id=a ID=b>yes", "yes"),
    ]
    for page, want in cases:
        assert html.extract(page)[1].strip() == want, (page, html.extract(page)[1])


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a b="', "<!", "<!--", "</", "<a b=c ", "<", "<a/", "&lt", "<style>@media screen{", "<style>@media x{", "<p a='b' ", "<![CDATA["])
def test_a_megabyte_of_any_start_takes_little_time(part):
    page = "seen " + part * (1_000_000 // len(part))
    begin = time.process_time()
    html.extract(page)
    assert time.process_time() - begin < 5  # some tenths of a second; quadratic time would be hours
