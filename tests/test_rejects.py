"""Faulty lines against a parser written by hand, character by character."""

import random
import re

import duckdb

from spanlake.operators.rejects import accepted, read_with_rejects, rejected

CONTIGS = [("1", 1000), ("X", 500), ("MT", 100)]
FILES = [("a.bed", 3), ("b.bed", 6), ("c.bed", 14)]


def fields(line):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            value, j = "", i + 1
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                value += line[j:k]
                if line[k + 1 : k + 2] != '"':
                    break
                value, j = value + '"', k + 2
            i = k + 1
            if i < len(line) and line[i] != "\t":
                return None
            out.append(value)
        else:
            k = line.find("\t", i)
            k = len(line) if k < 0 else k
            if '"' in line[i:k]:
                return None
            out.append(line[i:k])
            i = k
        if i >= len(line):
            return out
        i += 1


def reason(line, n_cols):
    line = line[:-1] if line.endswith("\r") else line
    f = fields(line)
    if f is None:
        return "quoting"
    if len(f) != n_cols:
        return "column_count"
    plain = re.sub("^chr", "", f[0])
    bases = dict(CONTIGS).get("MT" if plain == "M" else plain)
    if bases is None:
        return "contig"
    number = lambda s: int(s) if re.fullmatch("[0-9]+", s) else None
    s, e = number(f[1]), number(f[2])
    if s is None or s > 2147483647:
        return "pos_start"
    if e is None or e > 2147483647 or e <= s or e > bases:
        return "pos_end"
    if len(f) > 4 and f[4] != "." and (number(f[4]) is None or number(f[4]) > 1000):
        return "score"
    return None


def parse(spark, lines):
    raw = spark.createDataFrame(lines, "line_id bigint, source_file string, line string").selectExpr("*", "'x' AS reason", "1 AS contig", "2 AS n_cols")
    files = spark.createDataFrame(FILES, "source_file string, n_cols int").selectExpr("*", "'y' AS line")
    contigs = spark.createDataFrame(CONTIGS, "contig string, n_bases bigint").selectExpr("*", "0 AS pos_start")
    return read_with_rejects(raw, files, contigs)


def expected(lines):
    n = dict(FILES)
    kept = [x for x in lines if x[2] is not None and x[2].strip() and not re.match("(track|browser|#)", x[2], re.I)]
    return {i: reason(line, n.get(f)) for i, f, line in kept}


def test_kinds(spark):
    lines = [
        (1, "a.bed", "chr1\t0\t10"), (2, "a.bed", "1\t0\t10\r"), (3, "a.bed", "1\t0\t10\r\r"), (4, "a.bed", "chrM\t0\t100"), (5, "a.bed", "M\t0\t101"), (6, "a.bed", "chrchr1\t0\t1"), (7, "a.bed", "CHR1\t0\t1"),
        (8, "a.bed", '"1"\t"0"\t"10"'), (9, "a.bed", '"1\t0\t10'), (10, "a.bed", '1\t0"\t10'), (11, "a.bed", '"1"x\t0\t10'), (12, "a.bed", '1"\t"0\t10'), (13, "a.bed", "1\t+0\t10"), (14, "a.bed", "1\t0\t1e1"), (15, "a.bed", "1\t0_1\t5"),
        (16, "a.bed", "1\t 0\t10"), (17, "a.bed", "1\t0\t"), (18, "a.bed", "1\t\t"), (19, "a.bed", "1\t99999999999\t3"), (20, "a.bed", "1\t000000000000000000000000000000000000000000000007\t8"), (21, "a.bed", "1\t5\t5"),
        (22, "a.bed", None), (23, "a.bed", "   "), (24, "a.bed", "TRACK x"), (25, "a.bed", "#x"), (26, "a.bed", "Browser"), (27, "a.bed", ""), (28, "nowhere", "1\t0\t1"), (29, None, "1\t0\t1"),
        (30, "b.bed", '1\t0\t10\t"a\tb"\t5\t+'), (31, "b.bed", '1\t0\t10\t"say ""x"""\t.\t+'), (32, "b.bed", "1\t0\t10\tn\t1001\t+"), (33, "b.bed", "1\t0\t10\tn\t\t+"), (34, "b.bed", "1\t0\t10\tn\t-1\t+"), (35, "b.bed", "1\t0\t10\tn\t0999\t+"),
        (36, "b.bed", "1\t0\t10\tn\nm\t5\t+"), (37, "b.bed", "1\t0\t1\n0\tn\t5\t+"), (38, "b.bed", "1\t0\t10\t" + "n" * 3_000_000 + "\t5\t+"), (39, "c.bed", "1\t0\t10" + "\tx" * 11), (40, "c.bed", "1\t0\t10\tn\t5" + "\tx" * 9), (41, "a.bed", "1\t１\t10"),
        (42, "a.bed", 'G"'), (43, "a.bed", '"'), (44, "a.bed", "1\t0\t10"), (44, "a.bed", "1\t0\t10"), (45, "a.bed", "1\t0\t10\0"), (46, "b.bed", 'q"\t"\t\t\t\t'),
    ]
    df = parse(spark, lines)
    got = {r.line_id: r.reason for r in df.select("line_id", "reason").collect()}
    assert got == expected(lines)
    assert df.where("line_id = 44").count() == 2
    assert rejected(df).columns == ["line_id", "source_file", "line", "reason"]
    ok = {r.line_id: r for r in accepted(df).collect()}
    assert (ok[30].name, ok[30].score, ok[30].strand, ok[30].pos_start, ok[30].contig) == ("a\tb", 5, "+", 1, "1")
    assert (ok[31].name, ok[31].score) == ('say "x"', None)
    assert len(ok[38].name) == 3_000_000 and ok[4].contig == "MT" and ok[36].name == "n\nm"


def test_noise(spark):
    rng = random.Random(5)
    parts = ["1", "chr1", "X", "0", "5", "10", '"', '""', "\t", "\t", "\t", "a", ".", "\r", '"7"', "x", " "]
    lines = [(i, rng.choice(FILES[:2])[0], "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for i in range(3000)]
    got = {r.line_id: r.reason for r in parse(spark, lines).select("line_id", "reason").collect()}
    assert got == expected(lines)


def test_empty(spark):
    assert parse(spark, []).count() == 0


def test_fields_past_the_strand(spark, tmp_path):
    from spanlake.plans.problems import ORACLE, QUERIES

    files = [("d.bed", 12)]
    tails = ["5\t9\t57,170,0\t2\t3,4,\t0,5", "x\t\t1,x\t\t\t,", "5.5\t+9\t0\t1e1\t99999999999\t-1, 2", '"5"\t9\t"1,2,3"\t1\t"3,"\t,,']
    tables = {
        "bed_raw": spark.createDataFrame([(i, "d.bed", f"chr1\t0\t10\tn\t5\t+\t{t}") for i, t in enumerate(tails)], "line_id bigint, source_file string, line string"),
        "bed_source": spark.createDataFrame(files, "source_file string, n_cols int"),
        "contig_list": spark.createDataFrame([("1", 100)], "contig string, n_bases bigint"),
    }
    folder, con = str(tmp_path), duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    df = QUERIES["p1_typed"](spark, folder).orderBy("line_id")
    assert df.columns[-6:] == ["thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts"]
    got = [tuple(r) for r in df.collect()]
    assert [r[-6:] for r in got] == [(5, 9, [57, 170, 0], 2, [3, 4], [0, 5]), (None, None, None, None, None, None), (None, 9, [0], None, None, [-1, 2]), (5, 9, [1, 2, 3], 1, [3], None)]
    assert con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['p1_typed']}) ORDER BY line_id").fetchall() == got
