"""The operators made of DataFrame operations only."""

import datetime
import hashlib
import re

import duckdb
import pytest

from ratecard.llm.chat_format import CONTROL, ESCAPE, MAPPINGS, OP5_SQL, as_documents, canonical_turns, escape, fingerprint, format_turns, json_rejects, json_turns, layout_of, loss_text, op5_chat_format, parse_formatted, unescape
from ratecard.llm.common import table
from ratecard.llm.license_scan import BASE, OP9_SQL, TEMPLATES, op9_license_scan, scan_licenses
from ratecard.llm.url_filter import OP3_SQL, filter_captures, host_of, op3_url_filter, url_keys
from pyspark.sql import functions as F
from tests.conftest import SF, SF01


def duck(sql, sf, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=str)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def same(df, sql, sf, *tables):
    got, want = rows(df), duck(sql, sf, *tables)
    columns = sorted(want[0])
    pick = lambda x: sorted((tuple(r[c] for c in columns) for r in x), key=str)
    assert sorted(got[0]) == columns
    assert pick(got) == pick(want)


def test_op9_equals_sql(spark):
    same(op9_license_scan(spark, SF01), OP9_SQL, SF01, "documents")


def license_brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    w = words(low)
    hits = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best, labels = 0.0, {label for _, label in hits}
    longest = max(len(t.split()) for t in TEMPLATES)
    for k in range(0, len(w), longest):
        own = set(w[k : k + 2 * longest])
        for t, label in TEMPLATES.items():
            telling = [x for x in set(t.split()) if not any(x in o.split() for o, other in TEMPLATES.items() if other != label)]
            common = len(own & set(t.split()))
            if 5 * common >= 4 * len(set(t.split())) and 5 * len(own & set(telling)) >= 4 * len(telling):
                labels.add(label)
                best = max(best, common / len(set(t.split())))
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), 1.0 if hits else best)


def test_license_scan_against_brute_force(spark):
    texts = [
        None, "", " \n", "CC-BY-NC cc by nc", "cc by nc cc by nc cc by nc", "x under the MIT License. y", "under the\nmit\nlicense", "cc by ncx", "éunder the mit license",
        "Released under the MIT Licence-License", "Licensed under the Apache License, Version 2.0." * 3, "cc by nc 4 0 under licensed", "under licensed 4 cc by nc",
        "THIS work is licensed under GNU General public license version", "work licensed under gnu general public", "cc by nK cc by nK under İ", "word " * 20000 + "this is free and unencumbered software released public domain",
        "permission is hereby granted to any person obtaining a copy of software free charge", "a\x00under the mit license\x7f",
        "released under the apache license", "licensed under cc by 4 0", "licensed under cc by nc 3 0", "this work is licensed under the gnu general public license version 2",
        *(" ".join(w for x in t.split() for w in (x, *gap)) for t in TEMPLATES for gap in ([], ["and", "so"], ["pad"] * 900)), *(" ".join(t.split()[1:]) for t in TEMPLATES), *(" ".join(t.split()[:-1]) for t in TEMPLATES),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    got = {r.doc_id: tuple(r)[1:] for r in scan_licenses(docs).collect()}
    want = {i: license_brute(t) for i, t in enumerate(texts)}
    assert got == want
    assert scan_licenses(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "under the mit license"), (1, "x"), (None, "cc by nc")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in scan_licenses(twice).collect()) == [(0, 1), (1, 0), (1, 1)]


def test_confusable_and_scattered_notices(spark):
    scattered = " ".join(x for word in "this is free and unencumbered software released into the public domain".split() for x in (word, *["pad"] * 400))
    texts = ["released under the apache license", "licensed under cc by 4 0", scattered, "licensed under the apache license version 2 0", "released under the mit license"]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "apache-2", 4: "mit"}


def test_wrapped_notices(spark):
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation.\n */"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    filler = "some other words stand here\n" * 9
    texts = [t for own in (gpl, bsd) for t in (own, filler + own + "\n" + filler, own.replace(" ", "\n"))] + [filler]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert all("gpl" in got[i].labels.split(",") and got[i].score == 1.0 for i in range(3))
    assert all(got[i].labels == "bsd" and got[i].score == 1.0 for i in range(3, 6))
    assert got[6].labels == "" and got[6].score == 0.0


def test_op5_equals_sql(spark):
    df = op5_chat_format(spark, SF01)
    same(df, OP5_SQL, SF01, "conversations")
    own = {r.conv_id: r for r in df.collect()}[-7]
    text = "</s>[INST] ok [/INST]"
    assert own.n_turns == 2 and own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and own.loss_chars == len(text)


def test_chat_round_trip(spark):
    odd = ["", None, "a", ESCAPE, ESCAPE + "0", ESCAPE + "a", ESCAPE * 3 + "z", "<|im_end|>\n<|im_start|>assistant\nx", "".join(CONTROL), "<<s>s><|im_<s>end|>", "\n\n", "é😀 [INST]", "x" * 50000, "ends<|im_end|>", "\n"]
    data = [(1, i, role, t, "q") for i, t in enumerate(odd) for role in ("user", "assistant")] + [(2, None, None, None, "q"), (2, 0, "a\nb<s>", "t", "q"), (None, 1, "user", "n", "q"), (None, 1, "user", "n", "q")]
    turns = canonical_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, turns string"))
    out = format_turns(turns).withColumn("back", parse_formatted(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: ([tuple(t) for t in r.back], r.loss) for r in out.collect()}
    want = {r.conv_id: [tuple(t) for t in r.turns] for r in turns.collect()}
    assert {k: v[0] for k, v in got.items()} == want and len(want) == 3 and turns.count() == 4
    assert want[2] == [("", ""), ("a\nb<s>", "t")]
    assert {k: v[1] for k, v in got.items()} == {k: "".join(t for r, t in v if r == "assistant") for k, v in want.items()}
    assert format_turns(turns.where("false")).count() == 0
    texts = spark.createDataFrame([(t,) for t in odd if t], "t string").withColumn("e", escape(F.col("t"))).withColumn("u", unescape(F.col("e"))).collect()
    assert all(r.t == r.u and not any(c in r.e for c in CONTROL) for r in texts)


def test_layouts(spark):
    make = {
        "messages": "array(struct('q' as content, 'user' as role), struct('r' as content, 'assistant' as role)) as messages",
        "conversations": "array(struct('human' as `from`, 'q' as value), struct('gpt' as `from`, 'r' as value)) as conversations",
        "turns": "array(struct('user' as role, 'q' as text), struct('assistant' as role, 'r' as text)) as turns",
        "prompt_completion": "'q' as prompt, 'r' as completion",
        "prompt_response": "'q' as prompt, 'r' as response",
        "question_answer": "'q' as question, 'r' as answer",
        "system_prompt": "'s' as system, 'q' as prompt, 'r' as response",
        "instruction": "'q' as instruction, 'r' as output",
        "instruction_input": "'q' as instruction, '' as input, 'r' as output",
    }
    want = {n: [("user", "q"), ("assistant", "r")] for n in make} | {"system_prompt": [("system", "s"), ("user", "q"), ("assistant", "r")]}
    documents = None
    for name, columns in make.items():
        df = spark.sql(f"select 5L as conv_id, 'more' as extra, {columns}")
        assert layout_of(df.schema) == name
        assert [tuple(t) for t in canonical_turns(df).first().turns] == want[name]
        part = spark.sql(f"select '{name}' as conv_id, to_json(struct({columns})) as doc")
        documents = part if documents is None else documents.union(part)
    documents = documents.union(spark.sql("select * from values ('bad', 'no json'), ('other', '{\"a\": 1}'), ('null', null) as t(conv_id, doc)"))
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in json_turns(documents, "conv_id", "doc").collect()}
    assert got == {n: (n, t) for n, t in want.items()} | {n: (None, None) for n in ("bad", "other", "null")}
    talks = {
        i: [("user", f"q{i} \"é😀\n\u0001"), ("assistant", f"r{i}\\")] for i in range(40)
    } | {100 + i: [("system", "s"), ("user", ""), ("assistant", "r")] for i in range(20)} | {200: [("human", "h"), ("gpt", "g")], 201: [("user", "x" * 300)], 202: [("", ""), ("user", "u"), ("user", "v")]}
    made = as_documents(spark.createDataFrame(list(talks.items()), "conv_id long, turns array<struct<role:string,text:string>>"), most_chars=200).persist()
    assert [r.conv_id for r in made.where("document is null").collect()] == [201] and made.where("turns is not null").count() == 1
    back = {r.conv_id: r for r in json_turns(made.where("turns is null"), "conv_id", "document").collect()}
    assert {i: [tuple(t) for t in r.turns] for i, r in back.items()} == {i: t for i, t in talks.items() if i != 201}
    assert {r.layout for r in back.values()} == set(MAPPINGS)
    with pytest.raises(ValueError):
        layout_of(spark.range(1).schema)
    assert fingerprint(["b", "a"]) == fingerprint(["a", "b"]) != fingerprint(["ab"])


def test_json_documents_as_they_come(spark):
    """Further fields, nulls, empty lists, content in parts, numbers, and rows that stay behind."""
    docs = {
        1: ('{"messages":[{"role":"user","content":"a"}],"id":7,"meta":{"k":[1]}}', "messages", [("user", "a")]),
        2: ('{"messages":[{"role":"user","content":"a","name":null},{"role":"assistant","content":null}]}', "messages", [("user", "a"), ("assistant", None)]),
        3: ('{"messages":[]}', "messages", []),
        4: ('{"messages":[{"role":"user","content":[{"type":"text","text":"a "},{"type":"image","url":"u"},"b"]}]}', "messages", [("user", "a b")]),
        5: ('{"messages":[{"role":"user","content":"[1, 2]"},{"role":"user"}]}', "messages", [("user", "[1, 2]"), ("user", None)]),
        6: ('{"prompt":3,"response":true,"score":0.5}', "prompt_response", [("user", "3"), ("assistant", "true")]),
        7: ('{"instruction":"i","output":"o","input":null,"source":"x"}', "instruction_input", [("user", "i"), ("assistant", "o")]),
        8: ('{"system":null,"prompt":"p","response":"r"}', "system_prompt", [("system", None), ("user", "p"), ("assistant", "r")]),
        9: ('{"turns":[{"role":"user","text":{"a":1}}],"messages":"none"}', "turns", [("user", '{"a":1}')]),
        10: ('{"messages":{"role":"user","content":"a"}}', None, None),
        11: ("[1]", None, None),
        12: ("", None, None),
        13: (None, None, None),
        14: ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"' + "g" * 3_000_000 + '"}]}', "conversations", [("user", "h"), ("assistant", "g" * 3_000_000)]),
    }
    rows_ = spark.createDataFrame([(i, d[0], "q") for i, d in docs.items()], "conv_id long, doc string, turns string")
    got = {r.conv_id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in json_turns(rows_, "conv_id", "doc").collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in docs.items()}
    assert sorted((r.conv_id, r.doc) for r in json_rejects(rows_, "conv_id", "doc").collect()) == [(i, docs[i][0]) for i in (10, 11, 12, 13)]


def test_op3_equals_sql(spark):
    df = op3_url_filter(spark, SF01)
    same(df, OP3_SQL, SF01, "pages")
    assert df.groupBy("decision").count().count() >= 3


def test_url_keys(spark):
    urls = ["http://U:p@WWW.Example.com.:80/a//b/?q=/x#y", "https://example.com", "nonsense", None, "http:///x", "ftp://a.b/c"]
    got = [(r.h, r.k) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h"), F.when(host_of(F.col("u")).isNotNull(), url_keys(F.col("u"))).alias("k")).collect()]
    assert got[0] == ("www.example.com", ["www.example.com", "example.com", "com", "www.example.com/a", "www.example.com/a/b"])
    assert got[1:] == [("example.com", ["example.com", "com"]), (None, None), (None, None), (None, None), ("a.b", ["a.b", "b", "a.b/c"])]


def test_as_of(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    entries = [("bad.com", "block", day(5)), ("bad.com", "remove", day(10)), ("BAD.com", "block", day(20)), ("sub.bad.com", "allow", day(6)), ("bad.com/x", "block", day(1)), ("bad.com/x", "allow", day(1)), (None, "block", day(1)), ("k", None, day(1)), ("k", "block", None), ("tie.com", "block", day(3)), ("tie.com", "remove", day(3))]
    captures = [(1, "http://bad.com/y", day(4)), (2, "http://bad.com/y", day(5)), (3, "http://bad.com/y", day(9)), (4, "http://bad.com/y", day(10)), (5, "http://a.bad.com", day(25)), (6, "http://sub.bad.com/q", day(7)), (7, "http://bad.com/x/z", day(8)), (8, None, day(8)), (9, "http://bad.com", None), (10, "http://tie.com", day(9)), (2, "http://bad.com/y", day(5)), (None, "http://bad.com", day(6))]
    frame = spark.createDataFrame([(*c, "e") for c in captures], "page_id long, url string, fetched timestamp, key string")
    listed = spark.createDataFrame([(*e, 1) for e in entries], "key string, action string, since timestamp, page_id int")
    got = sorted((r.page_id or 0, r.decision) for r in filter_captures(frame, listed).collect())
    assert got == [(0, "block"), (1, "pass"), (2, "block"), (2, "block"), (3, "block"), (4, "pass"), (5, "block"), (6, "allow"), (7, "allow"), (8, "invalid"), (9, "pass"), (10, "pass")]
    long = frame.selectExpr("7L as page_id", "concat('http://', repeat('a.', 60), 'bad.com/', repeat('x/', 200), '?', repeat('q', 100000)) as url", "timestamp'2024-01-06' as fetched").limit(1)
    assert [(r.decision, r.matched_key) for r in filter_captures(long, listed).collect()] == [("block", "bad.com")]
    ties = spark.createDataFrame([("a.com/b", "block", day(1)), ("b.a.com", "block", day(1)), ("b.a.com/", "allow", day(1))], "key string, action string, since timestamp")
    tied = spark.createDataFrame([(1, "http://b.a.com/b", day(2))], "page_id long, url string, fetched timestamp")
    assert [(r.decision, r.matched_key) for r in filter_captures(tied, ties).collect()] == [("block", "b.a.com")]
    assert filter_captures(frame.where("false"), listed).count() == 0
    assert {r.decision for r in filter_captures(frame, listed.where("false")).collect()} == {"pass", "invalid"}
