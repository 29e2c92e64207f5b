import os
import random

import pytest
from pyarrow import fs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanlake import cli
from spanlake.converters import pileups as conv
from spanlake.functions import quality
from spanlake.session import Session
from spanlake.sinks.bam import BamWriter, write_file
from spanlake.sinks.tables import save_by_sample, write_pileup
from spanlake.sources import files, register, text
from spanlake.sources.bai import chunks, placed_records, write_index
from spanlake.sources.bam import header, records, samples
from spanlake.sources.sequences import read_name
from tests.conftest import rows


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track name=x\nBrowser y\nchr22\t1000\t5000\tcloneA\t960\t+\t1000\t5000\t0\t2\t567,488,\t0,3512\r\nchr11\t1000\t5000\n\nchrM\tx\t5\n")
    a, b, c = text.bed(spark, str(tmp_path / "a.bed")).orderBy(F.desc("contig")).collect()[1:], None, None
    full = text.bed(spark, str(tmp_path / "a.bed")).where("contig = '22'").first()
    assert (full.pos_start, full.pos_end, full.strand, full.block_sizes, full.block_starts, full.item_rgb) == (1001, 5000, "+", [567, 488], [0, 3512], [0])
    short = text.bed(spark, str(tmp_path / "a.bed")).where("contig = '11'").first()
    assert (short.pos_start, short.name, short.block_sizes) == (1001, None, None) and len(a) == 2 and b is c


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\nchr20\t14370\trs6\tG\tA\t29\tPASS\tNS=3;DB\tGT:GQ\t0|0:48\t1|0\n20\t17\t.\tGTC\tG,GTCT\t.\t.\tEND=40\tGT\t0/1\t./.\n20\t5\t.\tA\t.\t3\tq10;s50\t.\n")
    r = {x.pos_start: x for x in text.vcf(spark, str(tmp_path / "a.vcf")).collect()}
    assert len(r) == 3 and r[14369].contig == "20" and r[14369].pos_end == 14370 and r[14369].info == {"NS": "3", "DB": None}
    assert r[14369].genotypes == [{"GT": "0|0", "GQ": "48"}, {"GT": "1|0"}] and r[16].alt == ["G", "GTCT"] and r[16].pos_end == 40 and r[4].alt == [] and r[4].filters == ["q10", "s50"]
    assert text.vcf(spark, str(tmp_path / "a.vcf"), split_alleles=True).count() == 4


def test_vcf_left_aligned(spark):
    """A deletion in a run longer than two chunks of the reference goes to its beginning; what can't move stays."""
    bases = "GT" + "CA" * 16_000 + "TT"
    reference = spark.createDataFrame([("1", i + 1, bases[i : i + 10_000]) for i in range(0, len(bases), 10_000)], "contig string, chunk_start int, bases string")
    rows_in = [("1", 31_999, 32_002, "ACA", ["A"]), ("1", 5, 6, "A", ["<DEL>"]), ("1", 7, 8, "A", []), ("2", 9, 12, "ACA", ["A"]), ("1", 0, 1, "G", ["GG"]), ("1", 3, 40, "A", ["T"])]
    df = spark.createDataFrame(rows_in, "contig string, pos_start int, pos_end int, ref string, alt array<string>")
    got = {(r.contig, r.pos_start, r.pos_end, r.ref, *r.alt) for r in text.left_aligned(df, reference).collect()}
    assert got == {("1", 1, 4, "TCA", "T"), ("1", 5, 6, "A", "<DEL>"), ("1", 7, 8, "A"), ("2", 9, 12, "ACA", "A"), ("1", 0, 1, "G", "GG"), ("1", 3, 40, "A", "T")}


def test_fastq(spark, tmp_path):
    register(spark)
    rng = random.Random(0)
    reads = [(f"@EAS139:136:FC706VJ:2:2104:{i}:7 1:{'YN'[i % 2]}:18:ATCACG", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 90))), "@" * 3) for i in range(500)]
    (tmp_path / "S1.fastq").write_text("".join(f"{n}\n{s}\n+\n{q + 'I' * max(0, len(s) - 3)}\n" for n, s, q in reads))
    df = spark.read.format("fastq").option("splitSize", "3000").load(str(tmp_path))
    assert rows(df, "pos_x", "seq") == sorted((i, s) for i, (_, s, _) in enumerate(reads))
    first = df.where("pos_x = 0").first()
    assert (first.sample_id, first.instrument_name, first.run_id, first.lane, first.filter_passed, first.index_seq) == ("S1", "EAS139", 136, 2, False, "ATCACG")
    assert df.where("sample_id = 'other'").count() == 0 and read_name("@x") == {}


def test_fastq_blank_lines(spark, tmp_path):
    register(spark)
    blank = {3: "\n", 10: "\r\n \n", 40: "\n" * 500, 41: "\n" * 12, 199: "\n\n"}
    (tmp_path / "S1.fastq").write_bytes("".join(f"@r{i}\n{'ACGT' * (i % 9)}\n+\n{'@III' * (i % 9)}\n{blank.get(i, '')}" for i in range(200)).encode())
    want = sorted(("ACGT" * (i % 9), "@III" * (i % 9)) for i in range(200))
    for size in ("100000000", "3000", "211", "50"):
        df = spark.read.format("fastq").option("splitSize", size).load(str(tmp_path))
        assert sorted((r.seq, r.qual) for r in df.select("seq", "qual").collect()) == want


def test_fasta(spark, tmp_path):
    register(spark)
    rng = random.Random(1)
    contigs = {"chr1": "".join(rng.choice("acgtN") for _ in range(25_003)), "chrM": "ACGT"}
    (tmp_path / "r.fa").write_text("".join(f">{n} some\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in contigs.items()))
    want = {"1": contigs["chr1"].upper(), "MT": "ACGT"}

    def whole(split=1 << 30):
        out = {}
        for r in spark.read.format("fasta").option("splitBases", str(split)).load(str(tmp_path / "r.fa")).orderBy("contig", "chunk_start").collect():
            assert r.chunk_start == len(out.get(r.contig, "")) + 1
            out[r.contig] = out.get(r.contig, "") + r.bases
        return out

    assert whole() == want
    at = len(">chr1 some\n")
    second = at + 25_003 + -(-25_003 // 60) + len(">chrM some\n")
    (tmp_path / "r.fa.fai").write_text(f"chr1\t25003\t{at}\t60\t61\nchrM\t4\t{second}\t60\t61\n")
    assert whole() == whole(10_000) == whole(20_000) == want


def reads_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        length = rng.randint(1, 60)
        out.append({"qname": f"r{i}", "flag": rng.choice([0, 16]), "contig": rng.choice(["chr1", "chr2", None]), "mapq": 60, "cigar": f"{length}M", "pos_start": rng.randint(1, 9000), "rnext": "=", "pnext": 5, "tlen": -7, "seq": "".join(rng.choice("ACGTN") for _ in range(length)), "qual": "".join(chr(rng.randint(33, 73)) for _ in range(length)), "tag_NM": i, "tag_MD": str(length)})
    return out


def test_bam(spark, tmp_path):
    register(spark)
    contigs = {"chr1": 10_000, "chr2": 10_000}
    own = {s: reads_of(6000, s) for s in ("S1", "S2")}
    for s, reads in own.items():
        write_file(str(tmp_path / f"{s}.x.bam"), reads, contigs)
    for split in (1 << 30, 70_000, 9_000):
        df = spark.read.format("bam").option("splitSize", str(split)).load(str(tmp_path))
        got = rows(df, "sample_id", "qname", "contig", "pos_start", "cigar", "seq", "qual", "tag_NM", "tag_MD")
        assert got == sorted((s, r["qname"], r["contig"] and r["contig"][3:], r["pos_start"], r["cigar"], r["seq"], r["qual"], r["tag_NM"], r["tag_MD"]) for s, reads in own.items() for r in reads) or sorted(map(str, got)) == sorted(
            str((s, r["qname"], r["contig"] and r["contig"][3:], r["pos_start"], r["cigar"], r["seq"], r["qual"], r["tag_NM"], r["tag_MD"])) for s, reads in own.items() for r in reads
        )
    df = spark.read.format("bam").load(str(tmp_path))
    assert df.where("sample_id = 'S1' AND contig = '1' AND pos_start <= 500 AND pos_end >= 100").count() == sum(r["contig"] == "chr1" and r["pos_start"] <= 500 and r["pos_start"] + len(r["seq"]) - 1 >= 100 for r in own["S1"])
    assert samples(str(tmp_path)) == ["S1", "S2"] and df.first().pos_end == df.first().pos_start + len(df.first().seq) - 1
    out = df.where("contig IS NOT NULL").withColumn("contig", F.concat(F.lit("chr"), "contig"))
    out.write.format("bam").mode("append").option("contigs", "chr1:10000,chr2:10000").save(str(tmp_path / "out"))
    assert spark.read.format("bam").load(str(tmp_path / "out")).select("qname", "seq", "tag_NM").exceptAll(out.select("qname", "seq", "tag_NM")).count() == 0
    with pytest.raises(Exception, match="CRAM"):
        spark.read.format("cram").load(str(tmp_path)).count()


@settings(max_examples=12, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from([0, 1, 40, 150, 5_000, 60_000, 400_000, 1_000_000]), min_size=1, max_size=60), st.integers(1, 1 << 30))
def test_bam_splits(tmp_path_factory, lengths, seed):
    """Reads of up to a million bases: every split size gives each record once."""
    rng = random.Random(seed)
    path = str(tmp_path_factory.mktemp("b") / "S.bam")
    reads = []
    for i, n in enumerate(lengths * (3 if sum(lengths) < 3_000_000 else 1)):
        ops = f"{n}M" if n and rng.random() < 0.5 else f"{n // 2}M1D{n - n // 2}M" if n > 1 else "*"
        reads.append({"qname": f"r{i}", "flag": 0, "contig": rng.choice(["chr1", None]), "mapq": 9, "cigar": ops, "pos_start": 5 + i, "seq": "".join(rng.choices("ACGT", k=n)) if n < 5000 else ("ACGTTGCA" * (n // 8 + 1))[:n], "qual": "".join(chr(rng.randint(33, 73)) for _ in range(min(n, 300))).ljust(n, "I")})
    write_file(path, reads, {"chr1": 10_000_000})
    names, block, offset = header(path)
    size = os.path.getsize(path)
    for split in {size, size // 2 + 1, size // 7 + 1, 70_000, rng.randint(3_000, 200_000)}:
        got = [b[32 : 32 + b[8] - 1].decode() for at in range(0, size, split) for b in records(path, at, min(at + split, size), names, (block, offset))]
        assert got == [r["qname"] for r in reads], split


def test_bam_many_operations(spark, tmp_path):
    register(spark)
    cigar = "1M1I" * 40_000 + "5M"
    write_file(str(tmp_path / "S.bam"), [{"qname": "a", "flag": 0, "contig": "1", "cigar": cigar, "pos_start": 7, "seq": "A" * 80_005, "qual": "I" * 80_005}], {"1": 99_999})
    r = spark.read.format("bam").load(str(tmp_path)).first()
    assert (r.cigar, r.pos_end, len(r.seq), r.mapq) == (cigar, 40_011, 80_005, 255)


def test_bam_on_other_file_systems(tmp_path, monkeypatch):
    write_file(str(tmp_path / "S1.bam"), reads_of(300, 3), {"chr1": 10_000, "chr2": 10_000})
    assert files.listed(f"file://{tmp_path}/*.bam", (".bam",)) == files.listed(str(tmp_path), (".bam",)) == [str(tmp_path / "S1.bam")]
    far = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(files, "_system", lambda uri: (far, uri.removeprefix("far://box/")))
    assert files.listed("far://box/*.bam", (".bam",)) == ["far://box/S1.bam"] and files.exists("far://box/S1.bam") and not files.exists("far://box/S2.bam")
    names, block, offset = header("far://box/S1.bam")
    assert sum(1 for _ in records("far://box/S1.bam", 0, files.size_of("far://box/S1.bam"), names, (block, offset))) == 300
    writer = BamWriter({"path": "far://box/out", "contigs": "chr1:9,chr2:9", "sample": "S7"}, True)
    for _ in range(2):
        writer.commit([writer.write(iter([Row(**r) for r in reads_of(5, 1)]))])
    assert len(files.listed("far://box/out", (".bam",))) == 1 and files.sample_of(files.listed("far://box/out/*.bam", ())[0]) == "S7"
    with pytest.raises(FileNotFoundError):
        files.listed(f"{tmp_path}/*.nothing", (".bam",))


def test_fastq_cut_record(spark, tmp_path):
    register(spark)
    (tmp_path / "S1.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC")
    with pytest.raises(Exception, match="no whole record"):
        spark.read.format("fastq").load(str(tmp_path)).collect()


def test_index(spark, tmp_path):
    register(spark)
    reads = sorted((r for r in reads_of(20_000, 5) if r["contig"]), key=lambda r: (r["contig"], r["pos_start"]))
    for r in reads:
        r["pos_start"] *= 37
    path = str(tmp_path / "S1.bam")
    write_file(path, reads, {"chr1": 400_000, "chr2": 400_000})
    plain = spark.read.format("bam").load(path)
    queries = ["contig = '1' AND pos_end >= 100000 AND pos_start <= 120000", "contig = '2'", "contig IN ('1', '2') AND pos_start <= 40000", "contig = '1' AND pos_end >= 300000", "contig = '9'", "contig = '2' AND pos_start <= 0"]
    before = [rows(plain.where(q), "qname") for q in queries]
    write_index(path)
    names = [n for n, _, _ in ((b[32 : 32 + b[8] - 1].decode(), a, c) for a, c, b in placed_records(path, header(path)[1] << 16 | header(path)[2]))]
    assert names == [r["qname"] for r in reads]
    assert [rows(spark.read.format("bam").load(path).where(q), "qname") for q in queries] == before and all(before[:4])
    whole = {i for i, r in enumerate(reads) if r["contig"] == "chr1"}
    some = chunks(path + ".bai", {0}, 100_000, 120_000)
    assert some and sum(1 for a, b in some for _ in placed_records(path, a, b)) < len(whole) / 2


def test_session(spark, tmp_path):
    s = Session(spark)
    write_file(str(tmp_path / "S1.bam"), reads_of(300, 7), {"chr1": 10_000, "chr2": 10_000})
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW held_reads USING bam OPTIONS (path '{tmp_path}')")
    (tmp_path / "r.fa").write_text(">chr1\n" + "A" * 10_000 + "\n>chr2\n" + "C" * 10_000 + "\n")
    direct = s.coverage(str(tmp_path / "S1.bam"))
    by_sql = s.sql(f"SELECT * FROM coverage('held_reads', 'S1', '{tmp_path}/r.fa') c WHERE c.coverage > 1")
    assert rows(by_sql) == rows(direct.where("coverage > 1")) and by_sql.count() > 0
    p = s.sql(f"SELECT contig, count(*) n FROM pileup('held_reads', 'S1', '{tmp_path}/r.fa', true, true, 1) GROUP BY contig")
    assert p.count() == 2 and s.sql("SELECT bdg_shift(1, 2, 3).start AS x, coverage FROM (SELECT 7 AS coverage)").first() == (4, 7)
    assert s.samples("held_reads") == s.samples(str(tmp_path)) == ["S1"]
    assert "ref" in s.pileup(str(tmp_path / "S1.bam"), str(tmp_path / "r.fa")).columns
    (tmp_path / "t.tsv").write_text("GeneID\tChr\tStart\tEnd\tStrand\ng1\tchr1\t1\t9000\t+\n")
    cli.main(["feature-counts", "-r", str(tmp_path / "S1.bam"), "-a", str(tmp_path / "t.tsv"), "-o", str(tmp_path / "counts")])
    n = sum(r["contig"] == "chr1" for r in reads_of(300, 7))
    assert spark.read.option("header", "true").option("sep", "\t").csv(str(tmp_path / "counts")).first() == ("g1", "1", "1", "9000", "+", "9000", str(n))
    cli.main(["depth-of-coverage", "-r", str(tmp_path / "S1.bam"), "-o", str(tmp_path / "depth")])
    assert spark.read.option("header", "true").option("sep", "\t").csv(str(tmp_path / "depth")).count() == direct.count()


def test_pileup_texts(spark, tmp_path, capsys):
    assert [conv.clean_marks(x) for x in ("...,", "$A..$.,$", "$A^!..$.,$", "^~.", "^~.^$")] == ["...,", "A...,", "A...,", ".", "."]
    assert conv.split_indels("A+2GGt-1c.*") == ("At.*", [1])
    (tmp_path / "m.pileup").write_text('chr1\t5\ta\t3\t.-2CC,T\tI"I\nchr1\t6\tC\t3\t*,.\tIII\nchr1\t7\tC\t1\t*\tI\nchr1\t8\tC\t2\t.,\tII\n')
    common = conv.from_mpileup(text.mpileup(spark, str(tmp_path / "m.pileup")))
    out = rows(conv.maps_to_strings(common), "contig", "pos_start", "ref", "coverage", "alts", "quals")
    assert out == [("1", 5, "A", 3, "(T,1)", '(A,(",1)(I,1))(T,(I,1))'), ("1", 6, "C", 2, None, None), ("1", 8, "C", 2, None, None)]
    (tmp_path / "g.pileup").write_text("chr1 5 a AAcT III\n")
    g = conv.from_spaced_pileup(text.spaced_pileup(spark, str(tmp_path / "g.pileup"))).first()
    assert (g.contig, g.ref, g.coverage, g.alts) == ("1", "A", 4, {"A": 2, "T": 1, "c": 1})
    assert rows(conv.bases_to_blocks(common), "pos_start", "pos_end", "ref", "coverage") == [(5, 5, "A", 3), (6, 6, "C", 2), (8, 8, "C", 2)]
    blocks = spark.createDataFrame([("1", 3, 5, "ACG", 2, None, None), ("1", 8, 9, "R", 1, None, None)], "contig string, pos_start int, pos_end int, ref string, coverage int, alts map<string,int>, quals map<string,map<string,int>>")
    bases = conv.blocks_to_bases(blocks)
    assert rows(bases, "pos_start", "ref") == [(3, "A"), (4, "C"), (5, "G"), (8, "R"), (9, "R")]
    assert rows(conv.bases_to_blocks(bases), "pos_start", "pos_end", "ref") == [(3, 5, "ACG"), (8, 9, "RR")]
    write_pileup(common, str(tmp_path / "w"), single_file=True)
    assert text.block_pileup(spark, str(tmp_path / "w")).count() == 3
    flat_bases = tmp_path / "f"
    write_pileup(conv.maps_to_strings(common), str(flat_bases), single_file=True)
    cli.main(["compare-pileups", f"mpileup:{tmp_path}/m.pileup", f"blocks:{flat_bases}", f"spaced:{tmp_path}/g.pileup"])
    assert [x.rsplit(": ", 1)[1] for x in capsys.readouterr().out.splitlines() if " and " in x] == ["equal", "not equal", "not equal"]
    flat = conv.maps_to_strings(common)
    assert conv.compare_all({"a": flat, "b": flat, "c": flat.limit(2)}) == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}


def test_quality_functions(spark):
    quality.register(spark)
    df = spark.createDataFrame([({"A": [0, 2, 1], "c": [1, 0, 0]}, {65: 2, 99: 1}, 9)], "q map<string,array<int>>, b map<int,int>, n int")
    r = df.select(quality.quals_to_map("q").alias("m"), quality.quals_to_cov("q", "n").alias("n"), quality.alts_to_char("b").alias("c"), quality.alt_total("b").alias("t"), quality.altmap_to_str(quality.alts_to_char("b")).alias("s"), quality.qualsmap_to_str(quality.quals_to_map("q")).alias("z")).first()
    assert (r.m, r.n, r.c, r.t, r.s, r.z) == ({"A": {'"': 2, "#": 1}, "c": {"!": 1}}, 4, {"A": 2, "c": 1}, 3, "(A,2)(c,1)", '(A,(",2)(#,1))(c,(!,1))')
    s = df.selectExpr("quals_to_map(q) AS m", "quals_to_cov(q, n) AS n", "alts_to_char(b) AS c", "cov_equals(n, 9) AS e", "altmap_to_str(alts_to_char(b)) AS s", "qualsmap_to_str(quals_to_map(q)) AS z", "to_charmap(map(65, array(0, 1))) AS t", "quals_to_char(map(65, map('I', 2))) AS y", "quals_to_cov(null, n) AS k").first()
    assert (s.m, s.n, s.c, s.e, s.s, s.z, s.t, s.y, s.k) == (r.m, 4, r.c, True, r.s, r.z, {"A": {'"': 1}}, {"A": {"I": 2}}, 9)


def test_samples_as_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "sample_id string, contig string, pos_start int")
    path = str(tmp_path / "t")
    save_by_sample(df, path)
    save_by_sample(df.where("sample_id = 'a'").withColumn("pos_start", F.lit(9)), path, overwrite_samples=True)
    save_by_sample(df.where("sample_id = 'b'"), path)
    assert rows(spark.read.parquet(path), "sample_id", "pos_start") == [("a", 9), ("b", 2), ("b", 2)]
