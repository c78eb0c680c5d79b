"""Sentences, languages, documentation and provenance."""

import pytest

from graphlens.llm import chunklex, docpairs, language, provenance, sentences
from graphlens.llm.syntax.lexing import LANGUAGES

SPLITS = {
    'The log said "Disk full. Retry later." and the lock stopped. See sec. 2.2 and fig. 3 for it.': ['The log said "Disk full. Retry later." and the lock stopped.', "See sec. 2.2 and fig. 3 for it."],
    "Dr. Smith met Mr. Jones at 5 p.m. each day. It keeps trees, etc. Older ones stay.": ["Dr. Smith met Mr. Jones at 5 p.m. each day.", "It keeps trees, etc.", "Older ones stay."],
    "Loading ... then nothing. What?! rotate_it goes on (see a_b). (This stands alone.) Next": ["Loading ... then nothing.", "What?!", "rotate_it goes on (see a_b).", "(This stands alone.)", "Next"],
    "Am 3. Mai hat Dr. Alt z. B. den Ablauf geprüft. Gut.": ["Am 3. Mai hat Dr. Alt z. B. den Ablauf geprüft.", "Gut."],
    "Ne touchez pas !\n\nM. Paul et Mme. Orbec ont relu. Voir p. 42 ici": ["Ne touchez pas !", "M. Paul et Mme. Orbec ont relu.", "Voir p. 42 ici"],
    "他说：“磁盘已满。请稍后再试。”然后停止了。上限是39.52秒。为什么？": ["他说：“磁盘已满。请稍后再试。”然后停止了。", "上限是39.52秒。", "为什么？"],
    "バージョン（旧名。廃止。）を使いません。次へ": ["バージョン（旧名。廃止。）を使いません。", "次へ"],
    "ทำไมตัวชี้จึงหาย ขีดจำกัดคือ13.62วินาที ห้ามแก้ไข": ["ทำไมตัวชี้จึงหาย", "ขีดจำกัดคือ13.62วินาที", "ห้ามแก้ไข"],
    "डॉ. वेणुकर ने कहा। इसे मत बदलो!": ["डॉ. वेणुकर ने कहा।", "इसे मत बदलो!"],
    "# 2. Locks and more\nText goes\non here. Done\n- item one. Still one\n* two\n\n1. first\n2. second": ["2. Locks and more", "Text goes\non here.", "Done", "item one. Still one", "two", "first", "second"],
    "\r\n  \n": [],
    "": [],
}


@pytest.mark.parametrize("text", SPLITS)
def test_split(text):
    assert [text[a:b] for a, b in sentences.split(text)] == SPLITS[text]


def test_document_decides():
    # "lim" is followed by lower case elsewhere in the document, so it is an abbreviation in it
    text = "We set lim. to nine. The lim. Value is fixed."
    assert [text[a:b] for a, b in sentences.split(text)] == ["We set lim. to nine.", "The lim. Value is fixed."]
    assert len(sentences.split("The lim. Value is fixed.")) == 2
    assert len(sentences.split("The lim. Value is fixed.", {"lim": False})) == 1


def test_proper_names_behind_abbreviations():
    text = "Today Orbec wrote it. We ask Foo Inc. Orbec for it. We ask Foo Inc. Older ones stay."
    assert sentences.names(text) == {"Orbec", "Foo", "Inc"}
    assert [text[a:b] for a, b in sentences.split(text)] == ["Today Orbec wrote it.", "We ask Foo Inc. Orbec for it.", "We ask Foo Inc.", "Older ones stay."]
    # a word the document also writes small is no name
    assert sentences.names("We ask Orbec. An orbec is small, Über all.") == {"Über"}


def test_document_and_corpus_before_the_lists():
    # 'no' is on a list; the document has it end a block, the corpus may say that it can end a sentence
    assert len(sentences.split("He said no. Then he left.\n\nWe say no.")) == 3
    assert len(sentences.split("He met mr. Then he left.", {"mr": True})) == 2 and len(sentences.split("He met mr. Then he left.")) == 1
    long = "x" * 500
    assert len(sentences.split(f"We see {long}. One. The {long}. goes on.")) == 2


def test_evidence_does_without_the_lists(monkeypatch):
    """Sentences of the corpus with and without the lists: at least 99 in 100 the same."""
    import math
    from collections import Counter

    import duckdb

    rows = [t for (t,) in duckdb.sql("select distinct text from '/root/testdata/sf0.01/documents.parquet' where kind = 'prose' and text <> ''").fetchall()]
    total, small, followers = {}, set(), Counter()
    for t in rows:
        bare = sentences._bare(t)
        small |= set(sentences._small(t))
        for w, k in bare.items():
            total.setdefault(w, [0, 0, 0, 0])[3] += k
        for w, s in sentences.evidence(t, bare, followers).items():
            for n in range(3):
                total.setdefault(w, [0, 0, 0, 0])[n] += s[n]
    dots, bare, up, last = (sum(f(s) for s in total.values()) for f in (lambda s: sum(s[:3]), lambda s: s[3], lambda s: s[1], lambda s: s[2]))
    named, plain = Counter(), Counter()
    for (w, x), k in followers.items():
        (plain if x in small else named)[w] += k
    corpus, least = {}, math.log(sentences.LIKELIER)
    for w, (low, high, end, without) in total.items():
        n = low + high + end
        dotted, inside = sentences.title_terms(n, end, dots, bare, up, last, without)
        inside += max(0, sentences.name_terms(named[w], plain[w], sum(named.values()), sum(plain.values())))
        if n >= sentences.SEEN and low >= sentences.SHARE * n or n and not end and not low and dotted >= least and inside >= least:
            corpus[w] = not (n and not end and not low) and (end > 0 or high == 0)
    with_lists = [set(sentences.split(t, corpus)) for t in rows]
    monkeypatch.setattr(sentences, "NEVER_LAST", frozenset())
    monkeypatch.setattr(sentences, "MAY_BE_LAST", frozenset())
    same = sum(len(a & set(sentences.split(t, corpus))) for a, t in zip(with_lists, rows))
    assert same >= 0.995 * sum(map(len, with_lists))


def test_sentences_in_spark(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", "x"), (1, "Ab cd. Ef gh.", "x"), (2, None, "x"), (3, "", "x"), (None, "Q.", "x"), (4, "x " * 20000 + "yes. Zed", "x")], "doc_id long, text string, known string")
    rows = sorted(map(tuple, sentences.sentences(df).collect()))
    assert rows == [(1, 0, 6), (1, 7, 13), (4, 0, 40004), (4, 40005, 40008)]
    assert sentences.sentences(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    import duckdb

    rows = duckdb.sql("select text, lower(lang[1:2]) from '/root/testdata/sf0.01/documents.parquet' where kind = 'prose' and length(text) > 20 order by doc_id").fetchall()
    return language.fit([r for r in rows if r[1] in language.LANGUAGES][::2]), [r for r in rows if r[1] in language.LANGUAGES][1::2]


def test_held_out_accuracy(model):
    fitted, held = model
    # labels of the corpus are wrong in some rows, which bounds the accuracy from above
    assert sum(fitted.main(t)[0] == lang for t, lang in held) >= 0.9 * len(held)


def test_is_text():
    yes = ["Never edit the lock by hand!", "TODO(mk): Der Zeiger wird nur neu aufgebaut", "修改节点之前必须先获得锁", "@param x the value that is used here"]
    no = ["noqa: E501", "if (owner != null) { return resolve_token_slice(owner); }", "eslint-disable-next-line no-undef", "https://a.example/b", "The merge draft table.", "待补充", "???", "", None, "@param a\n@param b\n@return"]
    assert [language.is_text(t, "merge_draft_table") for t in yes] == [True] * 4
    assert [language.is_text(t, "merge_draft_table") for t in no] == [False] * len(no)


def test_label_comments(spark, model):
    df = spark.createDataFrame([("h::Function::f::1", "Der Knoten wird nur neu aufgebaut, wenn nötig.", [(4, "Never edit the lock by hand!"), (5, None), (None, "Never edit the lock by hand!"), (6, "x = 1")], "q"), ("h::Function::f::1", "Der Knoten wird nur neu aufgebaut, wenn nötig.", None, "q"), (None, "Never edit the lock by hand!", None, "q"), ("n", None, None, "q")], "node_id string, docstring string, inline_comments array<struct<line:int,text:string>>, lang string")
    got = sorted((r.node_id, r.line, r.lang) for r in language.label_comments(df, model[0]).collect())
    assert got == [("h::Function::f::1", 0, "de"), ("h::Function::f::1", 4, "en")]


CODE = {"a.py": 'x = "s" # c\n"""doc\n# not\n"""\ny = \'it\\\'s\'\n', "b.js": "let a = 'x'; // c1\n/* c2 * / */ let b = `t ${1} 'q'`; 4 / 2", "c.go": 'a := `raw // no` // yes\nb := "s\\"t"', "d.java": '/** doc */ String s = "a"; // z', "e.rs": "let a = \"x\ny\"; // c"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_compose(spark, size):
    df = spark.createDataFrame([*CODE.items(), ("n.py", None), ("u.txt", "'x'"), ("empty.py", "")], "file_path string, text string")
    want = sorted((p, s, k, t[s:e]) for p, t in CODE.items() for s, e, k, _, _ in chunklex.spans(t, LANGUAGES[p.rsplit(".", 1)[1]], chunklex.CODE) if e > s)
    assert sorted((r.file_path, r.start, r.kind, r.text) for r in chunklex.texts(df, chunk=size).collect()) == want


def test_chunks_of_the_tables(spark):
    """Every file of the smallest tables, read whole, in chunks of the usual size and in small ones."""
    from tests.helpers import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("kind = 'source'")
    assert docs.filter(f"length(text) > {chunklex.CHUNK}").count() > 0
    rows = [sorted(map(tuple, chunklex.texts(docs.dropDuplicates(["file_path"]), chunk=size).collect())) for size in (10**9, chunklex.CHUNK, 700)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 100


def test_each_language_of_a_comment(spark, model):
    text = "Der Knoten wird nur neu aufgebaut, wenn es wirklich nötig ist. The lock must never be edited by hand."
    df = spark.createDataFrame([("h", None, [(3, text)])], "node_id string, docstring string, inline_comments array<struct<line:int,text:string>>")
    assert {(r.line, r.lang) for r in language.label_comments(df, model[0], every=True).collect()} == {(3, "de"), (3, "en")}
    assert language.label_comments(df, model[0]).count() == 1
    long = "the " * 40 + "merge draft table"
    assert not language.is_text(long, "merge_draft_table")


def test_transitions_are_functions():
    a, b = 'x = "s', '" # c'
    f, g = chunklex.transition(a, "python"), chunklex.transition(b, "python")
    assert chunklex.compose(f, g) == chunklex.transition(a + b, "python")


def test_says_something():
    say = docpairs.says_something
    nothing = [None, "", "  ", "merge_draft()", "The merge draft.", "Merge Draft", "@param a\n@return", ":param a:\n:return:", '"""TODO"""', "/** FIXME */", "À compléter.", "TODO: write the documentation for this later.", "n/a", "<description>", "_summary_", "Noch zu dokumentieren.", "@inheritdoc", "-", "a, b"]
    something = ["Reads it from disk.", "@param a the number of rows", "修改节点之前必须先获得锁", "TODO Do not move this line", "[merge_draft] Waits for the lock", "Args:\n    a: what to read"]
    assert [say(d, "merge_draft", "def merge_draft(a, b)") for d in nothing] == [False] * len(nothing)
    assert [say(d, "merge_draft", "def merge_draft(a, b)") for d in something] == [True] * len(something)


def test_pairs(spark):
    py = 'def one():\n    """Reads one."""\n\ndef two():\n    x = 1\n    """no docstring"""\n\nclass A:\n    """of the class"""\n    @deco\n    def three(self,\n              a):\n        # c\n        "Reads three."\n'
    go = "package a\n\n// Waits for it.\nfunc One() {}\n\n// far away\n\nfunc Two() {}\n"
    js = "/** Runs it. */\nexport function a() {}\n/** for b */\nlet x = 1;\nfunction b() {}\n"
    docs = spark.createDataFrame([("r/a.py", py), ("r/b.go", go), ("r/c.js", js), (None, "x"), ("r/d.py", None)], "file_path string, text string")
    rows = [("1", "r/a.py", "one", 1), ("2", "r/a.py", "two", 4), ("3", "r/a.py", "three", 11), ("4", "r/b.go", "One", 4), ("5", "r/b.go", "Two", 8), ("6", "r/c.js", "a", 2), ("7", "r/c.js", "b", 5), ("8", "r/d.py", "z", 1), (None, "r/a.py", "one", 1)]
    nodes = spark.createDataFrame([(i, f, "FUNCTION", n, None, None, line, 1, "c", "l") for i, f, n, line in rows] + [("9", None, "method", "q", None, "Says enough here.", None, 1, "c", "l"), ("1", "r/a.py", "Class", "one", None, None, 1, 0, "c", "l"), ("10", "r/a.py", "Class", "A", None, "A class.", 8, 1, "c", "l")], "node_id string, file_path string, type string, name string, signature string, docstring string, start_line int, row_seq long, comment string, line string")
    got = {r.node_id for r in docpairs.pairs(nodes, docs).collect()}
    assert got == {"1", "3", "4", "6", "9"}
    assert docpairs.pairs(nodes.limit(0), docs).count() == 0


def test_pairs_behind_odd_places(spark):
    """Documentation is found in whole texts, behind templates and quotes or comments left open too."""
    one = {
        "py": 'def f{i}(a):\n    """Reads it, which isn\'t # all."""\n    return "v"\n\n',
        "ts": '/** Reads it, isn\'t "all". */\nfunction f{i}() {{\n  return `a ${{b}}\n c` + "v";\n}}\n\n',
        "java": '/** Reads it. */\nvoid f{i}() {{ var s = """\n  a\n  """; }}\n\n',
        "go": "/* Reads it. */\nfunc f{i}() {{ x := `a\nb`\n}}\n\n",
        "rs": '/** Reads it. */\nfn f{i}() {{ let s = "v"; }}\n\n',
    }
    odd = {
        "py": ['x = "open\n', 'x = f"{\n  a\n}"\n', 'def g():\n    """Left open\n    return a\n\n', '"""\n', "x = 'a' 'b\n"],
        "ts": ["x = `a`;\n", "x = `a ${b + `c ${d}`} e`;\n", "x = `a ${ {y: '}'} /* it's ` */ }`;\n", "x = `open;\n", "x = 'open /* y;\n", "<p>Don't {`\n a ${b}\n`}</p>\n", "x => /`/.test(y);\n", "x = `src/**`;\n"],
        "java": ['var s = """\n open\n', 'var s = "open /* x;\n'],
        "go": ["x := `open\n", 'x := "open\n'],
        "rs": ['/** A 5" disk */\nstruct A;\n', "/* it's /* nested */ \" */\n", "/* src/*.rs */\n", 'let s = "open;\n', '/* r#" */\n'],
    }
    files, nodes = [], []
    for ext, places in odd.items():
        for k, place in enumerate(["", *places]):
            text = "".join(one[ext].format(i=i) for i in range(2)) + place + "".join(one[ext].format(i=i) for i in range(2, 6))
            files.append((f"r/{k}.{ext}", text))
            nodes += [(f"{ext} {place} {i}", f"r/{k}.{ext}", text[: text.index(f" f{i}(")].count("\n") + 1) for i in range(6)]
    # what stands in a string documents nothing behind it
    strings = [("ts", "x = `\n/** Not its own. */\n`;\nfunction f() {}\n"), ("ts", "x = `\n/** Not its own. */\n`; function f() {}\n"), ("ts", "x = `/** Not its own. */`\nfunction f() {}\n"), ("rs", 'let x = "\n/** Not its own. */\n";\nfn f() {}\n'), ("go", "x := `\n/* Not its own. */\n`\nfunc f() {}\n")]
    for k, (ext, text) in enumerate(strings):
        files.append((f"s/{k}.{ext}", text))
        nodes.append((f"string {k}", f"s/{k}.{ext}", text[: text.index(" f(")].count("\n") + 1))
    columns = "node_id string, file_path string, type string, name string, signature string, docstring string, start_line int, row_seq long"
    got = docpairs.pairs(spark.createDataFrame([(i, p, "Function", "f", None, None, line, 1) for i, p, line in nodes], columns), spark.createDataFrame(files, "file_path string, text string")).collect()
    assert {r.node_id for r in got} == {i for i, p, _ in nodes if p[0] == "r"}
    assert all("Reads it" in r.documentation and len(r.documentation) < 50 for r in got)


def test_attribute_globs(spark):
    files = spark.createDataFrame([(p, "x = 1") for p in ("r/gen/a.py", "r/gen/keep.py", "r/src/b.pb.go", "r/src/deep/c.pb.go", "r/third/x.js", "s/gen/a.py", "r/src/deep/z.txt")] + [(None, "q")], "file_path string, text string")
    attributes = spark.createDataFrame([("r/.gitattributes", "# c\ngen/** linguist-generated\ngen/keep.py -linguist-generated\n*.pb.go linguist-generated=true\nthird/ linguist-vendored\n*.txt text"), ("r/src/deep/.gitattributes", "*.pb.go linguist-generated=false"), ("s/.gitattributes", None)], "file_path string, text string")
    got = {r.file_path: r.declared for r in provenance.declared(files, attributes).collect()}
    assert got == {"r/gen/a.py": "generated", "r/gen/keep.py": "", "r/src/b.pb.go": "generated", "r/src/deep/c.pb.go": "", "r/third/x.js": "vendored"}
    published = spark.createDataFrame([("t",)], "text string")
    out = {r.file_path: r.by for r in provenance.classify(files, published, attributes).collect()}
    assert out == {"r/gen/a.py": "declared", "r/src/b.pb.go": "declared", "r/third/x.js": "declared"}


def test_patterns_of_declared_repositories(spark):
    """Nested attribute files of three repositories; a fourth has none and gets what they have in common."""
    declaring = [f"{r}/{p}" for r in ("a", "b", "c") for p in ("out/x.py", "out/deep/y.js", "src/z.gen.go", "src/hand.py", "lib/keep/q.py", "lib/w.py")]
    plain = ["d/deep/out/m.py", "d/n.gen.go", "d/src/hand.py", "d/lib/v.py", "d/lib/keep/u.py"]
    files = spark.createDataFrame([(p, "x = 1\n") for p in declaring + plain], "file_path string, text string")
    attributes = spark.createDataFrame([x for r in ("a", "b", "c") for x in ((f"{r}/.gitattributes", "out/** linguist-generated\n*.gen.go linguist-generated\nlib/** linguist-vendored"), (f"{r}/lib/keep/.gitattributes", "* -linguist-vendored"))] * 2, "file_path string, text string")
    got = {r.file_path: (r.reason, r.by) for r in provenance.classify(files, spark.createDataFrame([], "text string"), attributes).collect()}
    want = {f"{r}/{p}": (why, "declared") for r in ("a", "b", "c") for p, why in (("out/x.py", "generated"), ("out/deep/y.js", "generated"), ("src/z.gen.go", "generated"), ("lib/w.py", "vendored"))}
    # lib is vendored in half of its files only, so it is no pattern
    assert got == want | {"d/deep/out/m.py": ("generated", "pattern"), "d/n.gen.go": ("generated", "pattern")}


def test_copies_against_all_pairs():
    import random
    from difflib import SequenceMatcher

    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    files = [[r.choice(words) for _ in range(r.randint(20, 120))] for _ in range(12)]
    known = provenance.Published([" ".join(f) for f in files])
    for _ in range(150):
        base = r.choice(files)
        rate = r.choice([0, 0.1, 0.19, 0.2, 0.21, 0.3, 0.6])
        other = [r.choice(words) if r.random() < rate else w for w in base] + [r.choice(words)] * r.randint(0, 9)
        want = any(SequenceMatcher(None, f, other, autojunk=False).ratio() >= 0.8 for f in files)
        assert known.is_copy(" ".join(other)) == want
    fifth = [w if k % 5 else f"new{k}" for k, w in enumerate(files[0][:100])]
    assert known.is_copy(" ".join(fifth)) == (SequenceMatcher(None, files[0], fifth, autojunk=False).ratio() >= 0.8)


def test_content_evidence(spark):
    upstream = "\n".join(f"def f{k}(a):\n    # note {k}\n    return g{k}(a, {k})" for k in range(20))
    known = provenance.Published([upstream])
    show = lambda t: provenance.evidence(t, known)
    hand = "import os\n\ndef a(x):\n    return os.getcwd() + x\n"
    assert show(None) == show("") == show(hand) == ""
    assert show("# Code generated by x. DO NOT EDIT.\n" + hand) == "generated" and show("/*\n * @generated\n */\nlet a = 1;") == "generated"
    assert show("# Please do not edit while the job runs.\n" + hand) == "" and show('x = "generated by hand"\n' + hand) == ""
    assert show("\n".join(x for x in upstream.split("\n") if "#" not in x).replace("g7", "local7")) == "vendored"
    assert show("// Copied from lib 1.2.3; see LICENSE\nlet a = 1;") == "vendored"
    assert show("FONT = [\n" + "".join(f"  {k}, {k + 1}, {k * 7},\n" for k in range(80)) + "]\n") == "data"
    assert show("".join(f"_A{k} = make(name='x{k}', number={k}, default=None)\n" for k in range(30))) == "generated"
    assert show("".join(f"function f{k}(a,b){{var c=a+b;return c?a:b}}" for k in range(60))) == "minified"
    assert show("TABLE = [" + ", ".join(map(str, range(80))) + "]\n" + hand * 2) == ""


def test_mined_patterns(spark):
    marked = [(f"r{k}/vendor/x{k}.py", "# Code generated by t. DO NOT EDIT.\nx = 1") for k in range(30)]
    df = spark.createDataFrame([*marked, ("q/vendor/plain.py", "x = 1\n"), ("q/src/plain.py", "x = 1\n"), ("q/src/plain.py", "x = 1\n")], "file_path string, text string")
    out = {r.file_path: (r.reason, r.by) for r in provenance.classify(df, spark.createDataFrame([("t",)], "text string")).collect()}
    assert len(out) == 31 and {by for _, by in out.values()} == {"pattern"} and out["q/vendor/plain.py"] == ("generated", "pattern") and "q/src/plain.py" not in out
    assert provenance.classify(df.limit(0), spark.createDataFrame([], "text string")).count() == 0


def _pieces(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in sorted(map(tuple, sentences.sentences(df).collect())):
        out.setdefault(r[0], []).append(texts[r[0]][r[1] : r[2]])
    return out


FILLER = ["The scheduler keeps what it was given. It waits for a slot. All others go on.\n\nA lock is held by one.", "Every reader sees one order. The log holds it all. Nothing else counts here.\n\nA new line is a new entry."]


def test_copies_of_a_text_are_no_evidence(spark):
    texts = [*FILLER, *["The work is completed. Then we leave the room."] * 40, "It is completed. Others follow."]
    got = _pieces(spark, texts)
    assert got[2] == ["The work is completed.", "Then we leave the room."]
    assert got[len(texts) - 1] == ["It is completed.", "Others follow."]


def test_uses_without_period_count_in_all_texts(spark):
    texts = [*FILLER, *(f"Step {k} is completed. Then we leave room {k} for others." for k in range(40)), *(f"All completed parts of batch {k} go out" for k in range(60))]
    assert _pieces(spark, texts)[2] == ["Step 0 is completed.", "Then we leave room 0 for others."]


def test_title_of_the_corpus(spark):
    texts = [*FILLER, *(f"We met Xyr. Smith{k} in room {k} on that day.\n\nThen item {k} was closed." for k in range(60))]
    assert _pieces(spark, texts)[2][0] == "We met Xyr. Smith0 in room 0 on that day."


def test_mark_below_a_long_licence():
    known = provenance.Published(["t"])
    licence = "".join(f"# Line {k} of the licence.\n" for k in range(60))
    assert provenance.evidence(licence + "# Code generated by x. DO NOT EDIT.\nimport os\n", known) == "generated"
    assert provenance.evidence(licence + "import os\n\n# Code generated by x. DO NOT EDIT.\n", known) == ""
