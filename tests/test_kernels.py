"""YAML, scripts, data fences, HTML, links and vocabularies against literal results and rules."""

import re

import pytest

from folio.kernels import vocab
from folio.kernels.fences import extract_data
from folio.kernels.script import compile_script, is_script_line
from folio.kernels.tree import Node, el, to_html, txt
from folio.kernels.urls import find_links
from folio.kernels.yaml12 import merge, parse_yaml, read_yaml

YAML = [
    ('bed: ~\nrow:\nleaf: null\nroot: NULL', ('{"bed":null,"row":null,"leaf":null,"root":null}', None)),
    ('dry: true\nwet: FALSE\nmoist: yes', ('{"dry":true,"wet":false,"moist":"yes"}', None)),
    ('n: 12\nm: -3\nk: +8\noct: 0o10\nhex: 0xff\nbin: 0b1\nlead: 010', ('{"n":12,"m":-3,"k":8,"oct":8,"hex":255,"bin":"0b1","lead":10}', None)),
    ('x: 2.50\ny: .25\nz: -1e2\nw: 6.02e23\nv: 3.\ninf: -.inf\nnan: .NaN', ('{"x":2.5,"y":0.25,"z":-100,"w":6.02e+23,"v":3,"inf":null,"nan":null}', None)),
    ('d: 2031-05-06\nt: 10:15\nu: 1_0\nv: 1.2.3', ('{"d":"2031-05-06","t":"10:15","u":"1_0","v":"1.2.3"}', None)),
    ('u: http://x.example/#top\nc: a #b', ('{"u":"http://x.example/#top","c":"a"}', None)),
    ('s: \'don\'\'t\'\nd: "tab\\there \\u2713 \\x41"', ('{"s":"don\'t","d":"tab\\there ✓ A"}', None)),
    ('d: "one\n  two\n\n  three"', ('{"d":"one two\\nthree"}', None)),
    ('p: one\n  two\n\n  three', ('{"p":"one two\\nthree"}', None)),
    ('l: |\n  a\n   b\n\n  c\n', ('{"l":"a\\n b\\n\\nc\\n"}', None)),
    ('l: |-\n  a\n', ('{"l":"a"}', None)),
    ('l: |+\n  a\n\n\n', ('{"l":"a\\n\\n\\n"}', None)),
    ('f: >\n  a\n  b\n\n  c\n', ('{"f":"a b\\nc\\n"}', None)),
    ('f: >-\n  a\n    code\n  b\n', ('{"f":"a\\n  code\\nb"}', None)),
    ('l: |1\n  a\n', ('{"l":" a\\n"}', None)),
    ('s:\n- x\n- - y\n  - z\n-\n  k: v', ('{"s":["x",["y","z"],{"k":"v"}]}', None)),
    ('- bed: 1\n  row: 2\n- bed: 3', ('[{"bed":1,"row":2},{"bed":3}]', None)),
    ('m: {a: 1, \'b c\': [2, {d: }], e: "f"}', ('{"m":{"a":1,"b c":[2,{"d":null}],"e":"f"}}', None)),
    ('m: [\n  a, # first\n  b,\n]', ('{"m":["a","b"]}', None)),
    ('m: {}\ns: []', ('{"m":{},"s":[]}', None)),
    ('\'q k\': 1\n"d k": 2\n3: x\nnull: y', ('{"q k":1,"d k":2,"3":"x","null":"y"}', None)),
    ('--- \nk: v', ('{"k":"v"}', None)),
    ('---\n- a', ('["a"]', None)),
    ('# only a comment\n', ('null', None)),
    ('', ('null', None)),
    ('plain words', ('"plain words"', None)),
    ('k: v # c\n# d\n\nj: w', ('{"k":"v","j":"w"}', None)),
    ("a: 'open\n  still'", ('{"a":"open still"}', None)),
    ('key with spaces: value: more', ('{"key with spaces":"value: more"}', None)),
    ('k: 1\nj: 2\nk: 3', (None, 'line 3: duplicate key in a mapping')),
    ('k: &a v', (None, 'line 1: anchors and aliases are not supported')),
    ('k: *a', (None, 'line 1: anchors and aliases are not supported')),
    ('k: !t v', (None, 'line 1: tags are not supported')),
    ('<<: {a: 1}', (None, 'line 1: merge keys are not supported')),
    ('a\n---\nb', (None, 'line 2: more than one document in a stream is not supported')),
    ('%TAG x\n---\na', (None, 'line 1: directives are not supported')),
    ('k:\n\t- v', (None, 'line 2: a tab cannot be used for indentation')),
    ("k: 'open", (None, 'line 1: unterminated single-quoted scalar')),
    ('k: "open', (None, 'line 1: unterminated double-quoted scalar')),
    ('k: [a', (None, 'line 1: unterminated flow sequence')),
    ('k: {a: 1', (None, 'line 1: unterminated flow mapping')),
    ('k: "\\z"', (None, 'line 1: unknown escape in a double-quoted scalar')),
    ('? k\n: v', (None, 'line 2: unexpected content after the document')),
    ('a: b\n  c: d', (None, 'line 2: unexpected content after the document')),
    ('- a\nb: c', (None, 'line 2: unexpected content after the document')),
    ('[a] b', ('["a"]', None)),
    ('k: |9x\n  a', (None, 'line 1: bad block scalar header')),
]


@pytest.mark.parametrize("source,want", YAML, ids=[repr(s)[:40] for s, _ in YAML])
def test_yaml(source, want):
    assert read_yaml(source) == want


SCRIPTS = [
    ('plain', 'const __out = []\n__out.push([0, `plain`])', "0"),
    ('% let n = 2\nrow {{ n }}', 'const __out = []\n let n = 2\n__out.push([1, `row ${ n }`])', "10"),
    ('%% plant({\n  rows: 3\n})\nend', 'const __out = []\n plant({\n  rows: 3\n})\n__out.push([3, `end`])', "1110"),
    ('%% plant({\n  rows: 3\nend', 'const __out = []\n plant({\n__out.push([1, `  rows: 3`])\n__out.push([2, `end`])', "100"),
    ('  \\% literal\n\\%% too', 'const __out = []\n__out.push([0, `  % literal`])\n__out.push([1, `%% too`])', "00"),
    ('\\{{ kept }} {{ done }}', 'const __out = []\n__out.push([0, `{{ kept }} ${ done }`])', "0"),
    ('{{ open', 'const __out = []\n__out.push([0, `{{ open`])', "0"),
    ('tick ` dollar $ slash \\ {{ a }}', 'const __out = []\n__out.push([0, `tick \\` dollar \\$ slash \\\\ ${ a }`])', "0"),
    ('{{ f({a: {b: 1}}) }} x', 'const __out = []\n__out.push([0, `${ f({a: {b: 1}) }} x`])', "0"),
    ('{{ \'}}\' + "}}" + `}}${ {c: 1}.c }` }}', 'const __out = []\n__out.push([0, `${ \'}\' + "}}" + \\`}}\\${ {c: 1}.c }\\` }}`])', "0"),
    ('%% f(\'{\', "(", `${ [1] }`, [\n  2\n])\nz', 'const __out = []\n f(\'{\', "(", `${ [1] }`, [\n  2\n])\n__out.push([3, `z`])', "1110"),
    ('%% g( /* ) { */ // ( {\n  1)\nz', 'const __out = []\n g( /* ) { */ // ( {\n  1)\n__out.push([2, `z`])', "110"),
    ('% a\r\n{{ b }}\r\n', 'const __out = []\n a\n__out.push([1, `${ b }`])\n__out.push([2, ``])', "100"),
    ('', 'const __out = []\n__out.push([0, ``])', "0"),
    ('%', 'const __out = []\n', "1"),
    ('%%\nx', 'const __out = []\n\n__out.push([1, `x`])', "10"),
    ('é 𒀀 {{ u }}', 'const __out = []\n__out.push([0, `é 𒀀 ${ u }`])', "0"),
]


@pytest.mark.parametrize("source,code,flags", SCRIPTS, ids=[repr(s)[:40] for s, *_ in SCRIPTS])
def test_script(source, code, flags):
    got, lines = compile_script(source)
    assert (got, "".join("01"[f] for f in lines)) == (code, flags)


FENCES = [
    ('intro\n```data\nk: 1\n```\noutro', ['k: 1'], 'intro\noutro'),
    ('~~~ Data\nk: 1\n~~~~\n\n```data\nj: 2\n```', ['k: 1', 'j: 2'], ''),
    ('```data x\nk: 1\n```', [], '```data x\nk: 1\n```'),
    ('```text\n```data\nk: 1\n```\n```', [], '```text\n```data\nk: 1\n```\n```'),
    ('`````\n```data\nk: 1\n```\n`````\nend', [], '`````\n```data\nk: 1\n```\n`````\nend'),
    ('```data\nno end', ['no end'], ''),
    ('    ```data\n    k: 1\n      j: 2\n    ```\nend', ['k: 1\n  j: 2'], 'end'),
    ('none', [], 'none'),
]


@pytest.mark.parametrize("source,yaml,rest", FENCES, ids=[repr(s)[:40] for s, *_ in FENCES])
def test_fences(source, yaml, rest):
    got, left = extract_data(source)
    assert ([f.yaml for f in got], left) == (yaml, rest)


LINKS = [
    ('go http://a.example/x?y=1#z, then', ['http://a.example/x?y=1#z']),
    ('(https://a.example/p_(q))', ['https://a.example/p_(q)']),
    ('ftp://f.example. end', ['ftp://f.example']),
    ('mailto:x.y@a.example and z@b.example', ['mailto:x.y@a.example', 'z@b.example']),
    ('http://a.example:70000/x', []),
    ('http://a.example:65535/x', ['http://a.example:65535/x']),
    ('x//a.example/y z', []),
    ('see //a.example/y z', ['//a.example/y']),
    ('HTTPS://A.EXAMPLE', ['HTTPS://A.EXAMPLE']),
    ('http://ä.example/ö', ['http://ä.example/ö']),
    ('http://xn--bcher-kva.example', ['http://xn--bcher-kva.example']),
    ('http:// a', []),
    ('a@b', []),
    ('a.b+c@d-e.example.', ['a.b+c@d-e.example']),
    ('http://a.example/"q" b', ['http://a.example/"q"']),
    ('http://a.example/a!b! c', ['http://a.example/a!b']),
    ('_http://a.example', []),
    ('http://a-.example/x', []),
]


@pytest.mark.parametrize("text,links", LINKS)
def test_links(text, links):
    assert [text[k.start : k.end] for k in find_links(text)] == links


#: What a scheme and host matched in one step must still leave, as matched part by part.
ODD_LINKS = [
    ('xhttp://a.example/b', []),
    ('éhttp://a.example/b', []),
    ('_ftp://a.example', []),
    ('(hTTps://a.example:80)x', ['hTTps://a.example:80']),
    ('httpſ://a.example', []),
    ('http://xn--a_.example/b', []),
    ('http://xn--abé.example/c', ['http://xn--abé.example/c']),
    ('http://a..b/c', ['http://a']),
    ('ftp://日本.example/路?q=(a[b])。 x', ['ftp://日本.example/路?q=(a[b])']),
    ('mailto:MAILTO:a@b.example', ['MAILTO:a@b.example']),
    ('http://a.example:99999//b.example/c', []),
    ('//localhost/a //b/c', ['//localhost/a']),
    ('http://a𠀀.example', ['http://a𠀀.example']),
    ('http://a.example|http://b.example', ['http://a.example|http']),
    ('http://a.b-/c', []),
]


@pytest.mark.parametrize("text,links", ODD_LINKS)
def test_odd_links(text, links):
    assert [text[k.start : k.end] for k in find_links(text)] == links


NODES = [
    (el("p", {"title": "5 < 6 & \"7\""}, txt("5 < 6 & \"7\"")), '<p title="5 < 6 &#x26; &#x22;7&#x22;">5 &#x3C; 6 &#x26; "7"</p>'),
    (el("style", {}, txt("a > b & c")), "<style>a > b & c</style>"),
    (el("td", {"headers": ["x", "y"], "colSpan": 2.0, "vAlign": "top"}), '<td headers="x y" colspan="2" valign="top"></td>'),
    (el("area", {"coords": ["1", "2"], "noHref": True}), '<area coords="1, 2" nohref>'),
    (el("video", {"autoPlay": True, "loop": False, "muted": "", "controls": "controls"}), "<video autoplay controls></video>"),
    (el("a", {"download": True, "hidden": ""}), "<a download hidden></a>"),
    (el("a", {"download": "f.txt", "dataRowId": "4", "data-x": "5", "xLinkHref": "#u", "xmlLang": "de", "acceptCharset": "utf-8"}), '<a download="f.txt" data-row-id="4" data-x="5" xlink:href="#u" xml:lang="de" accept-charset="utf-8"></a>'),
    (el("br", {}, txt("kept")), "<br>kept</br>"),
    (el("meter", {"value": 0.5}), '<meter value="0.5"></meter>'),
    (el("p", {"a b=": "c"}), '<p a&#x20;b&#x3D;="c"></p>'),
    (Node("root", children=[Node("doctype"), Node("comment", value="c"), Node("raw", value="<i>")]), "<!doctype html><!--c--><i>"),
]


@pytest.mark.parametrize("node,html", NODES, ids=[h[:30] for _, h in NODES])
def test_html(node, html):
    assert to_html(node) == html


def test_raw_is_escaped_where_it_is_not_trusted():
    assert to_html(el("p", {}, Node("raw", value="<i>&")), dangerous=False) == "<p>&#x3C;i>&#x26;</p>"


def test_numbers_that_no_double_holds():
    assert read_yaml("a: " + "9" * 400) == read_yaml("a: " + "9" * 5000) == read_yaml("a: 0x" + "f" * 600) == ('{"a":null}', None)
    assert parse_yaml("9" * 30) == 1e30
    assert read_yaml("- " * 3000 + "x") == (None, "line 1: nested too deeply")


def test_merge_keeps_places():
    assert list(merge({"a": 1, "b": 2}, [3], {"c": 4, "a": 5}).items()) == [("a", 5), ("b", 2), ("c", 4)]


def test_script_lines():
    assert [is_script_line(s) for s in ("%", " \t%x", "%%%", "a %", "\\%", "")] == [True, True, True, False, False, False]


def test_property_tables():
    assert len(vocab.ATTRIBUTES) == 363 and len(vocab.PROPERTIES) == 426
    for prop, attr in vocab.ATTRIBUTES.items():
        assert vocab.property_of(attr) == vocab.property_of(attr.upper()) == vocab.property_of(prop.lower()) == prop and vocab.attribute_of(prop) == attr
    assert [vocab.property_of(a) for a in ("data-bed-no", "DATA-X", "unknown", "Un-Known", "aria-nosuch", "onnosuch")] == ["dataBedNo", "dataX", "unknown", "Un-Known", "aria-nosuch", "onnosuch"]
    assert [vocab.attribute_of(p) for p in ("dataBedNo", "dataX", "fooBar")] == ["data-bed-no", "data-x", "fooBar"]


def test_emoticons():
    assert len(vocab.EMOTICONS) == 322 and max(map(len, vocab.EMOTICONS)) == 5
    colon = {f: p for f, p in vocab.EMOTICONS.items() if ":" in f and f != ":-"}
    assert all(vocab.EMOTICONS[f.replace(":", "=")] == p for f, p in colon.items())
    assert all(re.fullmatch("[!-~]{2,5}", f) for f in vocab.EMOTICONS)


def test_words_and_lines_of_yaml_are_told_once(monkeypatch):
    """No number is sought in a word, no comment where no # is, and no pattern is looked up by its text; the values stay."""
    tried = []

    class Pattern:
        def match(self, s):
            tried.append(s)

        search = match

    for name in ("_INT", "_FLOAT", "_COMMENT"):
        monkeypatch.setattr(f"folio.kernels.yaml12.{name}", Pattern())
    for name in ("match", "finditer"):
        monkeypatch.setattr(re, name, lambda *a: tried.append(a) or iter(()))
    assert read_yaml("---\na: plum\n c: e5\n  \n") == (None, "line 3: unexpected content after the document")
    assert read_yaml("a: plum\n  two\nb: |\n  x\n   y\nc: e5\nd: 'it''s'\nNo: true\n") == ('{"a":"plum two","b":"x\\n y\\n","c":"e5","d":"it\'s","No":true}', None)
    assert not tried
