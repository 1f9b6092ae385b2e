"""Top-level blocks of markdown and Treebank words: cases by type and line span, and spans of what the cases hold."""

import duckdb
import pytest

from quire import queries as Q
from quire.functions.markdown import Blocks, definitions, markdown_lines, markdown_nodes, table_begins
from quire.functions.treebank import treebank_spans

D = "/root/testdata/sf0.001"


def blocks(text):
    return [(b.kind, b.start, b.end) for b in Blocks([x.rstrip("\r\n") for x in markdown_lines(text)]).done]


# text, and type, first line, line behind the last of each block
CASES = [
    ("<http://foo.bar>\nx", [("paragraph",0,2)]),
    ("<b>inline</b> text\n", [("paragraph",0,1)]),
    ("<b>\nx\n", [("html_block",0,2)]),
    ("para\n<div>\nx\n\ny", [("paragraph",0,1),("html_block",1,3),("paragraph",4,5)]),
    ("para\n<b>\nx", [("paragraph",0,3)]),
    ("<script>\na\n\nb\n</script>\nc", [("html_block",0,5),("paragraph",5,6)]),
    ("text\n| a | b |\n| - | - |\n| 1 | 2 |\nend\n\nz", [("paragraph",0,1),("table",1,5),("paragraph",6,7)]),
    ("a | b\n---|---\n1|2\n> q", [("table",0,3),("blockquote",3,4)]),
    ("Foo\n---\n", [("heading",0,2)]),
    ("Foo\n***\n", [("paragraph",0,1),("hr",1,2)]),
    ("- a\n\n\nb", [("bullet_list",0,3),("paragraph",3,4)]),
    ("- a\n\n\n", [("bullet_list",0,3)]),
    ("-\n\n  foo\n", [("bullet_list",0,2),("paragraph",2,3)]),
    ("-\n  foo\n", [("bullet_list",0,2)]),
    ("- a\n+ b\n", [("bullet_list",0,1),("bullet_list",1,2)]),
    ("1. a\n2. b\n3) c", [("ordered_list",0,2),("ordered_list",2,3)]),
    ("para\n2. x\n", [("paragraph",0,2)]),
    ("para\n1. x\n", [("paragraph",0,1),("ordered_list",1,2)]),
    ("para\n-\nx\n", [("heading",0,2),("paragraph",2,3)]),
    ("para\n*\nx\n", [("paragraph",0,3)]),
    ("> a\nb\n\nc", [("blockquote",0,2),("paragraph",3,4)]),
    ("> ```\nfoo\n", [("blockquote",0,1),("paragraph",1,2)]),
    ("> # h\nfoo", [("blockquote",0,1),("paragraph",1,2)]),
    ("> - a\nb\n", [("blockquote",0,2)]),
    (">     code\n    more\n", [("blockquote",0,1),("code_block",1,2)]),
    ("> a\n---\n", [("blockquote",0,1),("hr",1,2)]),
    ("> a\n===\n", [("blockquote",0,2)]),
    ("- a\n  - b\n\n    c\n- d\n\ne", [("bullet_list",0,6),("paragraph",6,7)]),
    ("- a\n > b\n ```\n c\n ```\n- d", [("bullet_list",0,1),("blockquote",1,2),("fence",2,5),("bullet_list",5,6)]),
    ("    a\n\n    b\n\n\nc", [("code_block",0,3),("paragraph",5,6)]),
    ("a\n    b\n", [("paragraph",0,2)]),
    ("```\na\n\n", [("fence",0,3)]),
    ("~~~ a`b\nx\n~~~~\ny", [("fence",0,3),("paragraph",3,4)]),
    ("``` a`b\nx", [("paragraph",0,2)]),
    ("[foo]: /url 'title'\n\n[foo]", [("paragraph",2,3)]),
    ("[foo]: \n/url\n'the\ntitle'\nbar", [("paragraph",4,5)]),
    ("[foo]: /url 'x' y\n", [("paragraph",0,1)]),
    ("[foo]: /url\n===\n[foo]", [("paragraph",1,3)]),
    ("[foo]: /url\n\"x\" ok\n", [("paragraph",1,2)]),
    ("# \n#\n### a ###\n####### b", [("heading",0,1),("heading",1,2),("heading",2,3),("paragraph",3,4)]),
    ("#a\n", [("paragraph",0,1)]),
    ("- foo\n***\n- bar", [("bullet_list",0,1),("hr",1,2),("bullet_list",2,3)]),
    ("* a\n* * *\n* b", [("bullet_list",0,1),("hr",1,2),("bullet_list",2,3)]),
    ("<!-- a\n\nb -->\nx", [("html_block",0,3),("paragraph",3,4)]),
    ("<?php\n\n?>\nok", [("html_block",0,3),("paragraph",3,4)]),
    ("<!DOCTYPE html>\nx", [("html_block",0,1),("paragraph",1,2)]),
    ("<![CDATA[\n\n]]>\nx", [("html_block",0,3),("paragraph",3,4)]),
    ("<div>\n*x*\n</div>\n\ny", [("html_block",0,3),("paragraph",4,5)]),
    ("</ins>\n*bar*", [("html_block",0,2)]),
    ("<del>*foo*</del>", [("paragraph",0,1)]),
    ("    <!-- foo -->", [("code_block",0,1)]),
    ("10) a\n\n    b\n\nc", [("ordered_list",0,4),("paragraph",4,5)]),
    ("-\tfoo\n\n\tbar\n", [("bullet_list",0,3)]),
    (">\t\tfoo\n", [("blockquote",0,1)]),
    ("1. > q\n lazy\n\nx", [("ordered_list",0,3),("paragraph",3,4)]),
    ("> | a |\n> |---|\nfoo", [("blockquote",0,2),("paragraph",2,3)]),
    ("- | a |\n  |---|\n  | b |\nfoo", [("bullet_list",0,3),("paragraph",3,4)]),
    ("- a\nlazy\n\nb", [("bullet_list",0,3),("paragraph",3,4)]),
    (">\n> a\n>\nb", [("blockquote",0,3),("paragraph",3,4)]),
    ("> a\n\n> b", [("blockquote",0,1),("blockquote",2,3)]),
    ("a\r\nb\r\rc", [("paragraph",0,2),("paragraph",3,4)]),
    (" \nx", [("paragraph",0,2)]),
    ("   - a\n - b\n", [("bullet_list",0,2)]),
    ("-    five\n\n     x\ny", [("bullet_list",0,4)]),
    ("-     code\n\n  x\n", [("bullet_list",0,3)]),
    ("1234567890. no", [("paragraph",0,1)]),
    ("- a\n\n      code\n", [("bullet_list",0,3)]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_blocks(text, want):
    assert blocks(text) == want
    lines = markdown_lines(text)
    assert "".join(lines) == text
    assert [text[a:b] for _, a, b in markdown_nodes(text)] == ["".join(lines[a:b]) for _, a, b in want]


def test_blocks_of_long_texts():
    text = "> - a\n> \n>   b\n\n" * 20_000 + "x\n" * 50_000 + "<b>" * 30_000
    assert len(markdown_nodes(text)) == 20_001
    assert markdown_nodes("[" * 50_000) == [("paragraph", 0, 50_000)]


def test_heads_of_tables_and_definitions():
    assert table_begins("| a | b |", "|---|:-:|") and table_begins("a | b", "-|-") and not table_begins("a | b", "---")
    assert not table_begins("a", "---") and not table_begins("a \\| b | c", "-|-|-") and table_begins("a \\| b | c", "-|-")
    assert definitions(["[a]: /x", "[b]: <y z> 'title", "goes on'", "rest"]) == 3
    assert definitions(["[a]: f(x", "b"]) == 0 and definitions(["[]: /x"]) == 0 and definitions(["[a]:"]) == 0


WORDS = [
    ("They can't, don't (ok).",["They","ca","n't",",","do","n't","(","ok",")","."]),
 ("Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.",['Good','muffins','cost','$','3.88','in','New','York.','Please','buy','me','two','of','them.','Thanks','.']),
 ("They'll save and invest more.",['They',"'ll",'save','and','invest','more','.']),
 ("hi, my name can't hello,",['hi',',','my','name','ca',"n't",'hello',',']),
 ('"We beat some pretty good teams to get here," Slocum said.',['"','We','beat','some','pretty','good','teams','to','get','here',',','"','Slocum','said','.']),
 ("I cannot, gonna gimme wanna go 'tis d'ye lemme gotta more'n",["I","can","not",",","gon","na","gim","me","wan","na","go","'t","is","d","'ye","lem","me","got","ta","more","'n"]),
 ("a -- b...c (x) [y] {z} <w> 50% #1 a@b ; x?!",["a","--","b","...","c","(","x",")","[","y","]","{","z","}","<","w",">","50","%","#","1","a","@","b",";","x","?","!"]),
 ("``quoted'' and ''x''",["``","quoted","''","and","''","x","''"]),
 ("John's dogs' it's I'm 10:30, 1,000 x:y",["John","'s","dogs","'","it","'s","I","'m","10:30",",","1,000","x",":","y"]),
 ("end.)\"",["end",".",")",'"']), ("",[]),("  ",[]),
]


@pytest.mark.parametrize(("text", "want"), WORDS)
def test_treebank_words(text, want):
    assert [text[a:b] for a, b in treebank_spans(text)] == want


def test_treebank_spans_are_in_order():
    text = "\"It's 5 o'clock,\" she said -- ''never'' (or can't)... wanna\tgo? [x]\n" * 50
    spans = treebank_spans(text)
    assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert "".join(text[a:b] for a, b in spans) == "".join(text.split()) and treebank_spans(None) == []


@pytest.mark.parametrize("name", ["markdown_ast", "ast_listing", "treebank_spans"])
def test_derived_markdown_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    df = Q.QUERIES[name](spark, D)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())
