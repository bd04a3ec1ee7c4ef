from pulsewright.operators import noise
from pulsewright.sources import text

TIM = """FORMAT 1
MODE 1
C a comment about this file
file_1.ff 1410.250000 57123.123456789012340   2.750  ao  -fe L-wide -be PUPPI -chan 12 -snr 33.125 -be AGAIN
C file_2.ff 1410.250000 57123.123456789012340 2.750 ao -fe L-wide -cut snr
short.ff 1300 58000.5 2.0 gbt
INCLUDE other.tim
"""
PAR = """# Created: 2022-03-01T10:00:00
PSR J1122+3344
F0 250.25 1 1e-12
F1 -3.250000000125D-16  1  1.500000000625D-16
RAJ 11:22:33.4 1
DM 31.5
JUMP -fe Rcvr_800 0.001 1 0.0001
EFAC -f Rcvr1_2_GUPPI 1.05
"""


def test_tim_files(spark, tmp_path):
    (tmp_path / "a.tim").write_text(TIM)
    lines = text.read_lines(spark, str(tmp_path / "*.tim"))
    rows = text.parse_tim(lines).orderBy("line_no").collect()
    assert [r["name"] for r in rows] == ["file_1.ff", "short.ff"]
    assert str(rows[0].mjd_txt) == "57123.123456789012340" and rows[0].flags == {"fe": "L-wide", "be": "AGAIN", "chan": "12", "snr": "33.125"} and rows[1].flags == {}
    fixed, counts = text.uncomment(lines)
    assert counts.first().restored == 1 and text.parse_tim(fixed).count() == 3
    assert [r.file for r in text.included(lines).collect()] == ["other.tim"]


def test_line_numbers_of_files_that_are_split(spark, tmp_path):
    text_ = "".join(f"line {k} {'x' * (k * 37 % 90)}" + ("\r\n" if k % 3 else "\n") for k in range(20_000))
    (tmp_path / "long.txt").write_bytes(text_.encode())
    (tmp_path / "short.txt").write_text("\n\na\n\nb")
    (tmp_path / "empty.txt").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        lines = text.read_lines(spark, str(tmp_path / "*.txt"))
        rows = lines.collect()
        assert spark.read.text(str(tmp_path / "long.txt")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[1], {})[r.line_no] = r.value
    assert got == {"long.txt": dict(enumerate(text_.splitlines())), "short.txt": dict(enumerate(["", "", "a", "", "b"]))}
    assert lines.columns == ["path", "line_no", "value"]


def test_tim_written_and_read_again(spark, tmp_path):
    (tmp_path / "a.tim").write_text(TIM)
    from pyspark.sql import functions as F

    t = text.parse_tim(text.read_lines(spark, str(tmp_path / "a.tim"))).withColumn("psr", F.lit("P")).withColumn("cut", F.when(F.col("name") == "short.ff", "snr"))
    text.write_tim(text.renumber(t), str(tmp_path / "out"))
    again = text.parse_tim(text.read_lines(spark, str(tmp_path / "out" / "psr=P" / "*")))
    assert [r["name"] for r in again.collect()] == ["file_1.ff"]


def test_par_files(spark, tmp_path):
    (tmp_path / "a.par").write_text(PAR)
    lines = text.read_lines(spark, str(tmp_path / "a.par"))
    rows = {r["name"]: r for r in text.parse_par(lines).collect()}
    assert text.created_at(lines).first().created == "2022-03-01T10:00:00"
    assert rows["F1"].value == -3.250000000125e-16 and rows["F1"].fit and rows["F1"].uncertainty == 1.500000000625e-16
    assert rows["RAJ"].value is None and rows["RAJ"].value_txt == "11:22:33.4" and rows["RAJ"].fit
    assert not rows["DM"].fit and rows["DM"].uncertainty is None
    assert (rows["JUMP"].mask_key, rows["JUMP"].mask_value, rows["JUMP"].value, rows["JUMP"].fit) == ("-fe", "Rcvr_800", 0.001, True)
    assert (rows["EFAC"].mask_value, rows["EFAC"].value, rows["EFAC"].fit) == ("Rcvr1_2_GUPPI", 1.05, False)


def test_configs(spark):
    from pulsewright.sources import configs

    text_ = """
source: J1122+3344
toas: [a.tim, b.tim]
free-params: [F0, F1]
toa-type: NB
ignore:
  mjd-end: 59072.0
  snr-cut: 8
  bad-toa:
    - [fake.ff, 1, 1, noise]
    - [other.ff, 2]
  bad-range:
    - [0, 60000, fake]
  bad-file: [x, [y, reason]]
check:
  cleared: no
"""
    if configs.yaml:
        rows = configs.parse_configs(spark.createDataFrame([("c.nb.yaml", text_)], "path string, value string"))
        assert {(x.kind, x.reason, x.n) for x in configs.excised_reasons(rows).collect()} == {("bad-toa", "noise", 1), ("bad-toa", "reason missing", 1), ("bad-file", "reason", 1), ("bad-file", "reason missing", 1)}
        r = rows.first()
        assert r.psr == "J1122+3344" and r.ignore.snr_cut == 8.0 and [b["name"] for b in r.ignore.bad_toa] == ["fake.ff", "other.ff"]
        assert [tuple(b) for b in r.ignore.bad_range] == [(0.0, 60000.0, "fake")] and [tuple(b) for b in r.ignore.bad_file] == [("x", None), ("y", "reason")]


def test_top_mean_ties_and_blocks(spark):
    rows = [("c", k, [float(k), float(k % 3)]) for k in range(40)]
    got = noise.top_mean(spark.createDataFrame(rows, "chain string, sample long, vals array<double>"), n=4, burn=0.0, blocks=3)
    assert {(r.pos, r["mean"]) for r in got.collect()} == {(0, (38 + 35 + 32 + 29) / 4), (1, 2.0)}


def test_binary_models_against_stated_problems(spark):
    from pulsewright.operators import params as P

    full = {
        "A": ("ELL1", "A1 TASC EPS1 EPS2 PB"), "B": ("ELL1", "A1 TASC EPS1 EPS2 FB0 M2"), "C": ("ELL1", "A1 TASC EPS1 EPS2 PB FB0 M2"), "D": ("T2", "A1 ECC T0 PB OM M2"),
        "E": ("DDK", "A1 ECC T0 PB OM M2 KOM KIN"), "F": ("DD", "A1 ECC T0 OM EPS1DOT"), "G": ("ELL1H", "A1 PB TASC EPS1 EPS2 H3 EPS1DOT"), "H": ("BT", "A1"), "I": ("ELL1", "A1 TASC EPS1 EPS2"),
    }
    p = spark.createDataFrame([(s, n, (s, n) == ("A", "PB")) for s, (_, names) in full.items() for n in names.split()], "psr string, name string, frozen boolean")
    m = spark.createDataFrame([(s, k) for s, (k, _) in full.items()], "psr string, model string")
    assert sorted(tuple(r) for r in P.binary_check(p, m).collect()) == [
        ("A", "PB", "not fitted"), ("C", "M2+SINI", "one of a pair"), ("C", "PB/FB0", "not one of both"), ("D", "KIN", "missing"), ("D", "KOM", "missing"), ("E", "K96", "missing"), ("F", "PB", "missing"),
        ("G", "EPS1DOT+EPS2DOT", "one of a pair"), ("H", "BT", "unknown model"), ("I", "PB/FB0", "not one of both"),
    ]


def test_files_are_written_with_their_format_and_all_digits(spark, tmp_path):
    t = spark.createDataFrame([("P", 1, "f", 1400.0, 58000.5, "58000.123456789012345", 1.0, "ao", {"be": "X"}, None), ("P", 0, "f", 1400.0, 58000.5, None, 1.0, "ao", {"be": "X", "fe": "Y"}, "snr")], "psr string, toa_id long, name string, freq_mhz double, mjd double, mjd_txt string, err_us double, obs string, flags map<string,string>, cut string")
    text.write_tim(t.withColumn("mjd_txt", t.mjd_txt.cast("decimal(20,15)")), str(tmp_path / "tim"))
    lines = [r.value for r in text.read_lines(spark, str(tmp_path / "tim" / "psr=P" / "*.txt")).orderBy("line_no").collect() if r.value]
    assert lines == ["FORMAT 1", "C f 1400.000000 58000.500000000000000 1.000 ao -be X -fe Y -cut snr", "f 1400.000000 58000.123456789012345 1.000 ao -be X"]
    p = spark.createDataFrame([("P", 0, "F0", None, None, 100.5, True, 1e-9), ("P", 1, "JUMP", "-fe", "L", -2e-5, False, None)], "psr string, ord long, name string, mask_key string, mask_value string, value double, fit boolean, uncertainty double")
    text.write_par(p, str(tmp_path / "par"), fortran=True)
    lines = [r.value for r in text.read_lines(spark, str(tmp_path / "par" / "psr=P" / "*.txt")).orderBy("line_no").collect() if r.value]
    assert lines == ["F0 1.005000000000000D+02 1 1.000000000000000D-09", "JUMP -fe L -2.000000000000000D-05"]


def test_repeated_and_odd_flags(spark):
    lines = spark.createDataFrame([("p", 0, "f 1400 50000.5 1 ao -a 1 -b 2 -a 3"), ("p", 1, "f 1400 50000.5 1 ao"), ("p", 2, "f 1400 50000.5 1 ao -a 1 -b")], "path string, line_no int, value string")
    assert [r.flags for r in text.parse_tim(lines).orderBy("line_no").collect()] == [{"b": "2", "a": "3"}, {}, {"a": "1"}]
