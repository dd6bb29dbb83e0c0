import io
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm import chunking, mixing, warc

# --- mixing ----------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 33, "b": 31, "c": 19, "d": 11, "e": 6}])
def test_less_than_a_block_from_the_share(spark, parts):
    rows = mixing.period(spark, parts).collect()
    total = sum(parts.values())
    slots = {r.source: r.slots for r in rows}
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for name, weight in parts.items():
        assert len(slots[name]) == weight
        for n in range(total + 1):
            assert abs(sum(x < n for x in slots[name]) * total - n * weight) < total
        for j, slot in enumerate(slots[name]):
            assert j * total // weight <= slot < -(-(j + 1) * total // weight)


def test_wrong_weights(spark):
    docs = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    for wrong in ({}, {"a": 0}, {"a": mixing.MAX_PARTS + 1}):
        with pytest.raises(ValueError):
            mixing.period(spark, wrong)
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"a": 1})


def test_schedule_by_definition(spark):
    dice = random.Random(6)
    names = ["hot"] * 6 + ["b", "c", "d", None]
    rows = [(i, "x" * dice.choice([0, 1, 30, 250]), dice.choice(names)) for i in range(500)]
    rows += [(1000, None, "b"), (None, "null id", "c"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, slot int").repartition(5)
    parts, others, block = {"hot": 2, "b": 5}, 3, 100
    found = mixing.schedule(docs, parts, others, block).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in found) == sorted((d or -1, s or "") for d, _, s in rows)
    slots = {r.source: r.slots for r in mixing.period(spark, {**parts, mixing.OTHERS: others}).collect()}
    weights = {**parts, mixing.OTHERS: others}
    before = defaultdict(int)
    want = defaultdict(list)
    for d, t, s in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        group = s if s in parts else mixing.OTHERS
        start = before[group]
        before[group] += len(t or "")
        j = start // block
        want[d].append((start, j // weights[group] * 10 + slots[group][j % weights[group]]))
    for r in found:
        assert (r.start, r.slot) in want[r.doc_id]
    found.sort(key=lambda r: r.position)
    assert [r.position for r in found] == list(range(len(rows)))
    assert [(r.slot, r.start) for r in found] == sorted((r.slot, r.start) for r in found)
    assert mixing.schedule(docs.limit(0), parts, others).count() == 0


def test_mix_keeps_rows_in_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, f"text {i} " * 20, "ab"[i % 3 > 0]) for i in range(300)] + [(7, "text 7 " * 20, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixing.mix(docs, {"a": 3, "b": 1}, block=400).write.parquet(str(tmp_path / "mix"))
    read = spark.read.parquet(str(tmp_path / "mix"))
    assert read.columns == docs.columns
    got = read.orderBy("_metadata.file_name", "_metadata.row_index").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    places = {r.doc_id: r.position for r in mixing.schedule(docs, {"a": 3, "b": 1}, block=400).collect()}
    order = [places[r.doc_id] for r in got]
    assert order == sorted(order)


# --- chunks ----------------------------------------------------------------------------


def prose(dice, n):
    return " ".join("".join(dice.choices("abcdefgé", k=dice.randrange(2, 9))) for _ in range(n))


def test_cuts():
    dice = random.Random(1)
    for text in ("", "a", "é" * 1000, "a" * 5000, prose(dice, 3000)):
        data = text.encode()
        ends = chunking.cuts(data)
        assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert all(s <= chunking.MOST for s in sizes) and all(s >= chunking.LEAST - 3 for s in sizes[:-1])
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()


def test_cuts_come_back_after_an_insertion():
    data = prose(random.Random(2), 4000).encode()
    moved = b"something new " + data
    a, b = ({t[x:y] for x, y in zip([0, *ends], ends)} for t in (data, moved) if (ends := chunking.cuts(t)))
    assert len(a & b) > 0.98 * len(a)


def test_cuts_of_long_texts_do_not_depend_on_the_blocks():
    data = prose(random.Random(3), 250_000).encode()
    assert len(data) > 1 << 20
    begin = next(e for e in chunking.cuts(data) if e > 900_000)
    assert [e - begin for e in chunking.cuts(data) if e > begin] == chunking.cuts(data[begin:])


def test_repeated_passages_go(spark):
    dice = random.Random(4)
    passage, other = prose(dice, 70), prose(dice, 200)
    clean = [prose(dice, 120) for _ in range(20)]
    texts = [*clean, *(f"{prose(dice, 30)} {passage} {prose(dice, 25)}" for _ in range(12))]
    texts += [f"{prose(dice, 10)}\n{other}\n{prose(dice, 9)} {other} tail", None, "", prose(dice, 5) + " " + other]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, clean[0]), (3, clean[3])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, removed string")
    result = chunking.deduplicate(docs)
    assert result.columns == ["doc_id", "text", "n_chars", "removed"]
    found = result.collect()
    assert len(found) == len(rows)
    of = defaultdict(list)
    for r in found:
        of[r.doc_id].append(r)
    for i in range(1, 20):
        assert clean[i] in [r.text for r in of[i]] and len(of[i]) == (2 if i == 3 else 1)
    assert of[None][0].text == clean[0] and not of[None][0].removed  # null comes first
    assert len(of[0][0].text) < 0.3 * len(clean[0])
    assert sum(len(r.text) for r in of[3]) < 1.3 * len(clean[3])
    words = passage.split()
    for i in range(21, 32):
        row = of[i][0]
        assert [x.first_id for x in row.removed] == [20] and passage not in row.text
        gone = texts[i].encode()[row.removed[0].start :][: row.removed[0].length].decode()
        assert [w for w in gone.split() if w in words] == words and len(gone.split()) <= 72
        assert row.text.split() == [w for w in texts[i].replace(gone, "").split()]
    assert passage in of[20][0].text
    assert of[32][0].text.count(other[400:600]) == 1  # repeated within one text
    assert other[400:600] not in of[35][0].text
    assert of[33][0].text is None and of[34][0].text == ""
    assert chunking.deduplicate(docs.limit(0)).count() == 0


def test_repeats_of_two_documents_do_not_add_up(spark):
    dice = random.Random(11)
    rows, clean, repeated = [], [], []
    for i in range(0, 200, 10):
        p, q = prose(dice, 35), prose(dice, 35)
        rows += [(i, f"{prose(dice, 30)} {p} {prose(dice, 30)}"), (i + 1, f"{prose(dice, 30)} {q} {prose(dice, 30)}")]
        rows += [(i + 2, f"{prose(dice, 20)} {p} {q} {prose(dice, 20)}"), (i + 3, f"{prose(dice, 20)} {p} {q} {prose(dice, 20)}")]
        clean.append(i + 2)  # nothing of 40 words is repeated
        repeated.append((i + 3, f"{p} {q}"))  # 70 words that the document before has
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.doc_id: r for r in chunking.deduplicate(docs).collect()}
    texts = dict(rows)
    for i in clean:
        assert of[i].text == texts[i] and not of[i].removed
    whole = [i for i, _ in repeated if of[i].removed]
    assert len(whole) >= 18  # one without a cut in q has no chunk that only its source has
    for i, passage in repeated:
        if i in whole:
            assert [x.first_id for x in of[i].removed] == [i - 1] and passage not in of[i].text
            assert 70 <= of[i].removed[0].words <= 72


def test_each_run_passes_by_itself():
    data = " ".join(f"w{i:03}" for i in range(100)).encode()

    def run(a, b, source, shift):
        both = {"start": a, "end": b, "source": source, "shift": shift, "first_id": source, "length": 20, "digest": chunking.digest(data[a : a + 20])}
        return [{**both, "bytes": b""}, {**both, "bytes": b""}]

    assert chunking.cut(data.decode(), run(0, 150, 1, 0) + run(150, 300, 2, 0), 40)[1] == []
    assert [x["words"] for x in chunking.cut(data.decode(), run(0, 150, 1, 0) + run(150, 300, 1, 0), 40)[1]] == [60]
    both = chunking.cut(data.decode(), run(0, 225, 1, 0) + run(200, 450, 2, 0), 40)[1]
    assert [(x["start"], x["words"], x["first_id"]) for x in both] == [(0, 90, 1)]


# --- archives --------------------------------------------------------------------------


def page_rows():
    dice = random.Random(7)
    inner = warc._gzip(warc.record("<urn:page:1:1>", "http://x", b"trap", "d", None))
    pages = [(i, f"http://h/{i}", prose(dice, dice.randrange(1, 400))) for i in range(120)]
    pages += [(200 + i, f"http://copy/{i}", pages[i % 3][2]) for i in range(30)]
    pages += [(300, None, None), (301, "http://empty", ""), (302, "two\nlines", "é ü\r\n\r\nWARC/1.1"), (None, "n", pages[5][2])]
    pages += [(400, "same", "twice"), (400, "same", "twice"), (-5, "negative", inner.decode("latin-1"))]
    return pages


@pytest.mark.parametrize("split", [1 << 20, 997, 64])
def test_archives_round_trip(spark, tmp_path, split):
    pages = page_rows()
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    files = warc.write_archives(frame.repartition(3), str(tmp_path / "w"))
    assert sum(r.records for r in files.collect()) == len(pages)
    got = warc.read_archives(files, split).withColumn("page_id", warc.page_of("record_id")).withColumn("first", warc.page_of("refers_to")).collect()
    assert len(got) == len(pages)
    ids = {r.record_id for r in got}
    assert len(ids) == len(pages)
    by_payload = defaultdict(list)
    for p, _, html in pages:
        by_payload[(html or "").encode()].append(p)
    left = {k: list(v) for k, v in by_payload.items()}
    digests = {warc.payload_digest(k): k for k in by_payload}
    responses = defaultdict(int)
    for r in got:
        payload = digests[r.payload_digest]
        left[payload].remove(r.page_id)
        assert r.payload_bytes == len(payload)
        largest = max(by_payload[payload], key=lambda x: float("-inf") if x is None else x)
        if r.record_type == "response":
            responses[payload] += 1
            assert r.page_id == largest and bytes(r.payload) == payload and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.first == largest and r.refers_to in ids and r.payload is None
    assert not any(left.values()) and all(responses[k] == 1 for k in by_payload)


def test_empty_archives(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(frame, str(tmp_path / "w"))).count() == 0


def test_ranges_meet_in_as_many_tasks_as_they_need(spark):
    files = spark.createDataFrame([("file:/none", 10_000 * warc.SPLIT), ("file:/empty", 0)], "path string, bytes long")
    tasks = warc.ranges(files).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 10_000
    assert len(tasks) >= 1_000 and max(r["count"] for r in tasks) < 40
    few = warc.ranges(files.withColumn("bytes", F.lit(3 * warc.SPLIT).cast("long")).limit(1))
    assert few.count() == 3


def test_what_looks_like_a_member_is_none():
    good = [warc._gzip(warc.record(f"<urn:page:{i}:0>", "u", b"x" * i, "d", None)) for i in range(3)]
    other = zlib.compressobj(6, wbits=31)
    noise = warc.MAGIC + b"\0" * 7 + other.compress(b"not an archive") + other.flush()
    data = b"".join([good[0], good[1]])
    shifted = noise + data + good[2]
    found = list(warc.members(io.BytesIO(shifted), len(shifted), 3, len(shifted)))
    assert [x[0] for x in found] == [len(noise), len(noise + good[0]), len(noise + data)]
    broken = data[:-5]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(broken), len(broken), 0, len(broken)))


def test_a_wrong_payload_is_told():
    record = warc.record("<urn:page:1:0>", "u", b"payload", "d", None).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse(record)


def test_rows_of_the_page_table_are_written_once(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html"))
    rows = warc.read_archives(warc.write_archives(pages, str(tmp_path / "w")))
    assert {(r.record_type, r["count"]) for r in rows.groupBy("record_type").count().collect()} == {("response", 1), ("revisit", 49)}
