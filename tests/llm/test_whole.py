"""Inputs on which the operators' older forms left out a part of the job."""

import re

from pagelake.llm import licences, pii


def test_licences_where_notices_are_common(spark):
    """Many distinct notices are still named, and prose that uses a licence word or two isn't."""
    prose = "The harbour was quiet and number %d of the boats lay at anchor in the evening."
    notices = ["Copyright %d Firm%d Ltd. All rights reserved.", "Module%d, part %d, is licensed under the Apache License, Version 2.0.", "Part %d of kit%d is released under the MIT License."]
    rows = [(i, (notices[i % 3] % (1990 + i, i) + "\n" if i < 300 else "") + prose % i) for i in range(600)]
    rows += [(600 + i, f"Guest {i} asked for permission to bring a copy of the map.") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["families"] for r in licences.scan(docs).collect()}
    assert found == {i: [("proprietary", "apache", "mit")[i % 3]] if i < 300 else [] for i in range(650)}


def test_licences_of_notices_alone(spark):
    docs = spark.createDataFrame([(i, f"Copyright Firm{i}. All rights reserved.") for i in range(40)], "doc_id long, text string")
    assert {tuple(r["families"]) for r in licences.scan(docs).collect()} == {("proprietary",)}


def test_licences_learn_from_every_paragraph(spark):
    """Prose with a licence word, one paragraph among many of its document, is background wherever it stands."""
    plain = "The harbour was quiet and boat %d of %d lay at anchor.\n"
    prose = [f"The {w} of village %d was old." for w in ("affero", "cc", "lesser", "license", "permission", "restriction", "rights")] + ["The Mozilla team met in room %d."]
    notices = {"agpl": "Licensed under the GNU Affero General Public License, version 3.", "cc-by": "Licensed under CC BY 4.0.", "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "proprietary": "Copyright %d Firm Ltd. All rights reserved."}
    last = [(p % i, []) for p in prose for i in range(6)] + [(n.replace("%d", "1999"), [f]) for f, n in notices.items()]
    docs = spark.createDataFrame([(i, "".join(plain % (i, j) for j in range(80)) + t) for i, (t, _) in enumerate(last)], "doc_id long, text string")
    found = {r["doc_id"]: r["families"] for r in licences.scan(docs).collect()}
    assert found == {i: f for i, (_, f) in enumerate(last)}


def test_personal_data_beside_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", "4111111111111111 123", f"12 {card}", f"1234 {card}", f"{card} 123-45-6789", "12/31/1999 02/29/2000 31/12/1999", "+44 20 7946 0958", "+442079460958", "call 2125550123 now", "+33 1 23 45 67 89", f"{card} 12ab", "13/32/1999 1234567890123456 7", "7" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k", found=True).collect()}
    kinds = {i: [(pii.KINDS[s["k"]], texts[i][s["start"] : s["end"]]) for s in r["_found"]] for i, r in rows.items()}
    assert kinds == {0: [("card", card)], 1: [("card", card.replace(" ", ""))], 2: [("card", card)], 3: [("card", card)], 4: [("card", card), ("ssn", "123-45-6789")],
        5: [("date", d) for d in texts[5].split(" ")], 6: [("phone", texts[6])], 7: [("phone", texts[7])], 8: [("phone", "2125550123")], 9: [("phone", texts[9])], 10: [("card", card)], 11: [], 12: []}
    for i, r in rows.items():
        assert re.sub("[0-9]", "0", r["text"]) == re.sub("[0-9]", "0", texts[i]) and all(value not in r["text"] for _, value in kinds[i])


def test_month_first_dates_stay_apart(spark):
    days = spark.sql("SELECT id AS doc_id, date_format(date_add(date'1900-01-01', cast(id AS int)), 'MM/dd/yyyy') AS text FROM range(73049)").where("substring(text, 4, 2) > '12'")
    out = pii.pseudonymised(days, "k").cache()
    assert out.select("text").distinct().count() == days.count() and out.where("try_to_date(text, 'MM/dd/yyyy') IS NULL OR substring(text, 4, 2) <= '12'").count() == 0


def test_spans_of_many_hits(spark):
    """Places of thousands of hits in one text, past several runs of parts, as a plain scan finds them."""
    words = [f"user{i}@mail.example.org" if i % 3 else f"née {i} \U0001f600" for i in range(3_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, words[1]), (3, "no hit, 4 @")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k", found=True).collect()}
    assert [(s["start"], s["end"]) for s in rows[1]["_found"]] == [m.span() for m in re.finditer(r"user\d+@mail\.example\.org", text)]
    assert [(s["start"], s["end"]) for s in rows[2]["_found"]] == [(0, len(words[1]))] and rows[3]["_found"] == []
