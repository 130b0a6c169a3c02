"""Markdown: literal cases of the public CommonMark and GFM specifications, as HTML of the tree."""

import time

import pytest

from folio.kernels.markdown import parse_markdown
from folio.kernels.tree import to_html

CASES = [
    ("# foo", '<h1 id="foo">foo</h1>'),
    ("Foo *bar*\n=========", '<h1 id="foo-bar">Foo <em>bar</em></h1>'),
    ("a\nb\n\nc", "<p>a\nb</p>\n<p>c</p>"),
    ("***", "<hr>"),
    ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>"),
    ("- a\n  - b", "<ul>\n<li>a<ul>\n<li>b</li>\n</ul></li>\n</ul>"),
    ("3. a", '<ol start="3">\n<li>a</li>\n</ol>'),
    ("> # Foo\n> bar\nbaz", '<blockquote>\n<h1 id="foo">Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>'),
    ("```ruby\ndef x\n```", '<pre><code class="language-ruby">def x\n</code></pre>'),
    ("    code", "<pre><code>code\n</code></pre>"),
    ("`` foo ` bar ``", "<p><code>foo ` bar</code></p>"),
    ("**foo** _bar_ ~~x~~", "<p><strong>foo</strong> <em>bar</em> <del>x</del></p>"),
    ("***strong emph***", "<p><em><strong>strong emph</strong></em></p>"),
    ("foo*bar*baz snake_case_name", "<p>foo<em>bar</em>baz snake_case_name</p>"),
    ('[link](/uri "title")', '<p><a href="/uri" title="title">link</a></p>'),
    ('[foo]\n\n[foo]: /url "t"', '<p><a href="/url" title="t">foo</a></p>'),
    ("![foo *bar*](src)", '<p><img src="src" alt="foo bar"><em></em></img></p>'),
    ("<http://foo.bar>", '<p><a href="http://foo.bar">http://foo.bar</a></p>'),
    ("see www.x.com/a. a@b.co", '<p>see <a href="http://www.x.com/a">www.x.com/a</a>. <a href="mailto:a@b.co">a@b.co</a></p>'),
    ("&copy; &#35; &nope;", "<p>© # &#x26;nope;</p>"),
    ("a  \nb\\\nc", "<p>a<br>b<br>c</p>"),
    ("\\*not\\*", "<p>*not*</p>"),
    ("<div>\nx\n</div>", "<div>\nx\n</div>\n"),
    ("| a | b |\n| - | :-: |\n| 1 | 2 |", '<table>\n<thead>\n<tr>\n<th>a</th>\n<th align="center">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td align="center">2</td>\n</tr>\n</tbody>\n</table>'),
    ("- [x] done", '<ul class="contains-task-list">\n<li class="task-list-item"><input type="checkbox" checked disabled> done</li>\n</ul>'),
    ("", ""),
]

#: Tabs, lists, quotes and lazy lines, by the rules of the specification.
CONTAINERS = [
    ("- a\n - b\n  - c\n   - d\n    - e","<ul>\n<li>a</li>\n<li>b</li>\n<li>c</li>\n<li>d\n- e</li>\n</ul>"),
    ("\tfoo\tbaz\t\tbim","<pre><code>foo\tbaz\t\tbim\n</code></pre>"),
    ("  \tfoo\tbaz\t\tbim","<pre><code>foo\tbaz\t\tbim\n</code></pre>"),
    ("  - foo\n\n\tbar","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>"),
    ("- foo\n\n\t\tbar","<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>"),
    (">\t\tfoo","<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>"),
    ("-\t\tfoo","<ul>\n<li><pre><code>  foo\n</code></pre></li>\n</ul>"),
    ("    foo\n\tbar","<pre><code>foo\nbar\n</code></pre>"),
    (" - foo\n   - bar\n\t - baz","<ul>\n<li>foo<ul>\n<li>bar<ul>\n<li>baz</li>\n</ul></li>\n</ul></li>\n</ul>"),
    ("#\tFoo",'<h1 id="foo">Foo</h1>'),
    ("*\t*\t*\t","<hr>"),
    ("- `one\n- two`","<ul>\n<li>`one</li>\n<li>two`</li>\n</ul>"),
    ("- foo\n***\n- bar","<ul>\n<li>foo</li>\n</ul>\n<hr>\n<ul>\n<li>bar</li>\n</ul>"),
    ("* Foo\n* * *\n* Bar","<ul>\n<li>Foo</li>\n</ul>\n<hr>\n<ul>\n<li>Bar</li>\n</ul>"),
    ("- Foo\n- * * *","<ul>\n<li>Foo</li>\n<li><hr></li>\n</ul>"),
    ("> Foo\n---","<blockquote>\n<p>Foo</p>\n</blockquote>\n<hr>"),
    ("> foo\nbar\n===","<blockquote>\n<p>foo\nbar\n===</p>\n</blockquote>"),
    ("- Foo\n---","<ul>\n<li>Foo</li>\n</ul>\n<hr>"),
    ("> # Foo\n> bar\n> baz",'<blockquote>\n<h1 id="foo">Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>'),
    ("> bar\nbaz\n> foo","<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>"),
    ("> foo\n---","<blockquote>\n<p>foo</p>\n</blockquote>\n<hr>"),
    ("> - foo\n- bar","<blockquote>\n<ul>\n<li>foo</li>\n</ul>\n</blockquote>\n<ul>\n<li>bar</li>\n</ul>"),
    (">     foo\n    bar","<blockquote>\n<pre><code>foo\n</code></pre>\n</blockquote>\n<pre><code>bar\n</code></pre>"),
    ("> ```\nfoo\n```","<blockquote>\n<pre><code></code></pre>\n</blockquote>\n<p>foo</p>\n<pre><code></code></pre>"),
    ("> foo\n    - bar","<blockquote>\n<p>foo\n- bar</p>\n</blockquote>"),
    ("> foo\n\n> bar","<blockquote>\n<p>foo</p>\n</blockquote>\n<blockquote>\n<p>bar</p>\n</blockquote>"),
    ("> > > foo\nbar","<blockquote>\n<blockquote>\n<blockquote>\n<p>foo\nbar</p>\n</blockquote>\n</blockquote>\n</blockquote>"),
    (">     code\n\n>    not code","<blockquote>\n<pre><code>code\n</code></pre>\n</blockquote>\n<blockquote>\n<p>not code</p>\n</blockquote>"),
    ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.","<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>"),
    ("- one\n\n two","<ul>\n<li>one</li>\n</ul>\n<p>two</p>"),
    ("   > > 1.  one\n>>\n>>     two","<blockquote>\n<blockquote>\n<ol>\n<li>\n<p>one</p>\n<p>two</p>\n</li>\n</ol>\n</blockquote>\n</blockquote>"),
    (">>- one\n>>\n  >  > two","<blockquote>\n<blockquote>\n<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n</blockquote>\n</blockquote>"),
    ("- foo\n\n\n  bar","<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>"),
    ("- Foo\n\n      bar\n\n\n      baz","<ul>\n<li>\n<p>Foo</p>\n<pre><code>bar\n\n\nbaz\n</code></pre>\n</li>\n</ul>"),
    ("-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz","<ul>\n<li>foo</li>\n<li><pre><code>bar\n</code></pre></li>\n<li><pre><code>baz\n</code></pre></li>\n</ul>"),
    ("-\n\n  foo","<ul>\n<li></li>\n</ul>\n<p>foo</p>"),
    ("- foo\n-\n- bar","<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>"),
    ("foo\n*\n\nfoo\n1.","<p>foo\n*</p>\n<p>foo\n1.</p>"),
    ("> 1. > Blockquote\ncontinued here.","<blockquote>\n<ol>\n<li><blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote></li>\n</ol>\n</blockquote>"),
    ("- foo\n  - bar\n    - baz\n      - boo","<ul>\n<li>foo<ul>\n<li>bar<ul>\n<li>baz<ul>\n<li>boo</li>\n</ul></li>\n</ul></li>\n</ul></li>\n</ul>"),
    ("10) foo\n    - bar",'<ol start="10">\n<li>foo<ul>\n<li>bar</li>\n</ul></li>\n</ol>'),
    ("- - foo","<ul>\n<li><ul>\n<li>foo</li>\n</ul></li>\n</ul>"),
    ("1. - 2. foo",'<ol>\n<li><ul>\n<li><ol start="2">\n<li>foo</li>\n</ol></li>\n</ul></li>\n</ol>'),
    ("- # Foo\n- Bar\n  ---\n  baz",'<ul>\n<li><h1 id="foo">Foo</h1></li>\n<li><h2 id="bar">Bar</h2>baz</li>\n</ul>'),
    ("- foo\n- bar\n+ baz","<ul>\n<li>foo</li>\n<li>bar</li>\n</ul>\n<ul>\n<li>baz</li>\n</ul>"),
    ("The number is\n14.  doors","<p>The number is\n14.  doors</p>"),
    ("The number is\n1.  doors","<p>The number is</p>\n<ol>\n<li>doors</li>\n</ol>"),
    ("- a\n\n- b\n\n\n- c","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>"),
    ("- a\n- b\n\n- c","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>"),
    ("* a\n*\n\n* c","<ul>\n<li>\n<p>a</p>\n</li>\n<li></li>\n<li>\n<p>c</p>\n</li>\n</ul>"),
    ("- a\n- b\n\n  [ref]: /url\n- d","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>d</p>\n</li>\n</ul>"),
    ("- a\n- ```\n  b\n\n\n  ```\n- c","<ul>\n<li>a</li>\n<li><pre><code>b\n\n\n</code></pre></li>\n<li>c</li>\n</ul>"),
    ("- a\n  - b\n\n    c\n- d","<ul>\n<li>a<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul></li>\n<li>d</li>\n</ul>"),
    ("* a\n  > b\n  >\n* c","<ul>\n<li>a<blockquote>\n<p>b</p>\n</blockquote></li>\n<li>c</li>\n</ul>"),
    ("* foo\n  * bar\n\n  baz","<ul>\n<li>\n<p>foo</p>\n<ul>\n<li>bar</li>\n</ul>\n<p>baz</p>\n</li>\n</ul>"),
    ("- a\n  - b\n  - c\n\n- d\n  - e\n  - f","<ul>\n<li>\n<p>a</p>\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>\n<p>d</p>\n<ul>\n<li>e</li>\n<li>f</li>\n</ul>\n</li>\n</ul>"),
    ("1. a\n\n  2. b\n\n    3. c","<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n<pre><code>3. c\n</code></pre>"),
    ("[foo]: /url\n===\n[foo]",'<p>===\n<a href="/url">foo</a></p>'),
    ("[foo]: /url\n---\n[foo]",'<hr>\n<p><a href="/url">foo</a></p>'),
    ("```\n\n  \n```","<pre><code>\n  \n</code></pre>"),
    ("   ```\n   aaa\n    aaa\n  aaa\n   ```","<pre><code>aaa\n aaa\naaa\n</code></pre>"),
    ("````\naaa\n```\n``````","<pre><code>aaa\n```\n</code></pre>"),
    ("> ```\n> aaa\n\nbbb","<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>"),
    ("foo\n```\nbar\n```\nbaz","<p>foo</p>\n<pre><code>bar\n</code></pre>\n<p>baz</p>"),
    ("~~~~    ruby startline=3 $%@#$\ndef\n~~~~~~~",'<pre><code class="language-ruby">def\n</code></pre>'),
    ("    chunk1\n      \n      chunk2","<pre><code>chunk1\n  \n  chunk2\n</code></pre>"),
    ("Foo\n    bar","<p>Foo\nbar</p>"),
    ("    foo\nbar","<pre><code>foo\n</code></pre>\n<p>bar</p>"),
    ("<div>\n*foo*\n\n*bar*","<div>\n*foo*\n\n<p><em>bar</em></p>"),
    ("- <div>\n- foo","<ul>\n<li><div>\n</li>\n<li>foo</li>\n</ul>"),
    ("Foo\n<div>\nbar\n</div>","<p>Foo</p>\n<div>\nbar\n</div>\n"),
    ("| a | b |\n|---|---|\n| c | d |\n> q","<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>c</td>\n<td>d</td>\n</tr>\n</tbody>\n</table>\n<blockquote>\n<p>q</p>\n</blockquote>"),
    ("- | a |\n  |---|\n  | b |","<ul>\n<li><table>\n<thead>\n<tr>\n<th>a</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>b</td>\n</tr>\n</tbody>\n</table></li>\n</ul>"),
    ("- [ ] a\n  - [x] b",'<ul class="contains-task-list">\n<li class="task-list-item"><input type="checkbox" disabled> a<ul class="contains-task-list">\n<li class="task-list-item"><input type="checkbox" checked disabled> b</li>\n</ul></li>\n</ul>'),
]


@pytest.mark.parametrize("source,html", [*CASES, *CONTAINERS], ids=[repr(s) for s, _ in [*CASES, *CONTAINERS]])
def test_markdown(source, html):
    assert to_html(parse_markdown(source)) == html


LEAVES = {
    "paragraph": ("alpha\nbeta", "<p>alpha\nbeta</p>"),
    "heading": ("## beta", '<h2 id="beta">beta</h2>'),
    "setext": ("gamma\n===", '<h1 id="gamma">gamma</h1>'),
    "rule": ("___", "<hr>"),
    "code": ("    x\n\n    y", "<pre><code>x\n\ny\n</code></pre>"),
    "fence": ("```c\nd\n\n\te\n```", '<pre><code class="language-c">d\n\n\te\n</code></pre>'),
    "html": ("<div>\nz\n</div>", "<div>\nz\n</div>\n"),
    "list": ("+ q\n+ r", "<ul>\n<li>q</li>\n<li>r</li>\n</ul>"),
    "loose": ("+ q\n\n+ r", "<ul>\n<li>\n<p>q</p>\n</li>\n<li>\n<p>r</p>\n</li>\n</ul>"),
    "table": ("| a |\n|---|\n| b |", "<table>\n<thead>\n<tr>\n<th>a</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>b</td>\n</tr>\n</tbody>\n</table>"),
}
WRAPS = {"quote": ("> ", "> "), "bullet": ("- ", "  "), "wide bullet": ("*   ", "    "), "number": ("1. ", "   "), "tab": ("-\t", "\t")}
#: A tab after three columns is one column wide, which is another text.
NESTS = [(a,) for a in WRAPS] + [(a, b) for a in WRAPS for b in WRAPS if (a, b) != ("number", "tab")] + [("quote", "bullet", "quote"), ("bullet", "bullet", "tab"), ("number", "quote", "bullet"), ("tab", "tab", "quote")]


@pytest.mark.parametrize("nest", NESTS, ids=["-".join(n) for n in NESTS])
@pytest.mark.parametrize("leaf", LEAVES)
def test_blocks_inside_containers(leaf, nest):
    """Each leaf inside up to three containers: written line by line, and its HTML put together from the parts."""
    source, html = LEAVES[leaf]
    if leaf == "code" and {"wide bullet", "tab"} & set(nest):
        pytest.skip("the columns of indented code count from another place")
    for name in reversed(nest):
        first, other = WRAPS[name]
        lines = source.split("\n")
        source = "\n".join([first + lines[0], *[(other + x if x else other.rstrip(" \t")) for x in lines[1:]]])
        if "quote" in name:
            html = f"<blockquote>\n{html}\n</blockquote>"
        else:
            tag = "ol" if name == "number" else "ul"
            plain = html[3:-4] if html.startswith("<p>") else html
            html = f"<{tag}>\n<li>{plain}</li>\n</{tag}>"
    assert to_html(parse_markdown(source)) == html


def test_depth_has_a_bound_and_time_is_linear():
    assert to_html(parse_markdown("> " * 127 + "x")).count("<blockquote>") == 127
    deep = to_html(parse_markdown("> " * 5000 + "x"))
    assert deep.count("<blockquote>") == 127 and "&#x3E;" not in deep and deep.count("> >") > 0

    def took(text):
        began = time.process_time()
        parse_markdown(text)
        return time.process_time() - began

    for line in ("- a\n", "> a\n", "a\n\n", "- a\n\n  b\n", "    code\n\n"):
        took(line * 100)
        assert took(line * 8_000) < 14 * max(took(line * 1_600), 0.01)


#: Lines that start with letters, lazy ones, and headings inside other blocks.
LETTERS = [
    ('> # a b\n> - ## c\n\nd e\n===', '<blockquote>\n<h1 id="a-b">a b</h1>\n<ul>\n<li><h2 id="c">c</h2></li>\n</ul>\n</blockquote>\n<h1 id="d-e">d e</h1>'),
    ('ªb\n- x\n\tya\n\néa|b\n-|-', '<p>ªb</p>\n<ul>\n<li>x\nya</li>\n</ul>\n<table>\n<thead>\n<tr>\n<th>éa</th>\n<th>b</th>\n</tr>\n</thead>\n</table>'),
    ('> > a\nlazy\n\nb<br>\n<div>\nc', '<blockquote>\n<blockquote>\n<p>a\nlazy</p>\n</blockquote>\n</blockquote>\n<p>b&#x3C;br></p>\n<div>\nc\n'),
    ('a  \nb\\\nc\n\n<div>\n# d\n</div>\n\n# e', '<p>a<br>b<br>c</p>\n<div>\n# d\n</div>\n\n<h1 id="e">e</h1>'),
]


@pytest.mark.parametrize("source,html", LETTERS)
def test_lines_that_start_with_letters(source, html):
    assert to_html(parse_markdown(source)) == html


def test_no_pattern_of_a_block_is_tried_on_a_letter(monkeypatch):
    """Such lines are most of a text; only a tree's headings are looked at again for their ids."""
    tried = []

    class Pattern:
        def match(self, s):
            tried.append(s)

    for name in ("_SETEXT", "_HR", "_ITEM", "_TABLE", "_ATX", "_FENCE"):
        monkeypatch.setattr(f"folio.kernels.markdown.{name}", Pattern())
    monkeypatch.setattr("folio.kernels.tree.Node.walk", lambda self: tried.append(self) or iter(()))
    assert to_html(parse_markdown("> c5\nlazy|x\n\néa b")) == "<blockquote>\n<p>c5\nlazy|x</p>\n</blockquote>\n<p>éa b</p>"
    assert not tried


@pytest.mark.parametrize(
    "source,html",
    [
        ("a  \nb\\\nc\n\n<div>\nd\n</div>", "<p>a<br>b<br>c</p>\n<div>\nd\n</div>\n"),
        ("a &lt; b  \n*c*  \n[d](e)", '<p>a &#x3C; b<br><em>c</em><br><a href="e">d</a></p>'),
        ("a [b\nc](d) ~~e~~\\\nf", '<p>a <a href="d">b\nc</a> <del>e</del><br>f</p>'),
        ("a ] b * c\n![d", "<p>a ] b * c\n![d</p>"),
    ],
)
def test_breaks_with_and_without_marks(source, html):
    assert to_html(parse_markdown(source)) == html


def test_lines_of_a_paragraph_are_measured_once(monkeypatch):
    from folio.kernels import markdown

    measured, indent = [], markdown._indent
    monkeypatch.setattr(markdown, "_indent", lambda s, col: measured.append(s) or indent(s, col))
    assert to_html(parse_markdown("a  \nb\\\nc\nd")) == "<p>a<br>b<br>c\nd</p>"
    assert measured == ["a  ", "b\\", "c", "d"]
