"""Classification, redundancy, scoring and feedback on hand-written rows."""

import io
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dossier.functions import fixed, rules
from dossier.operators import dedup, explain, extract, feedback, inventory, model, report, score, serve, vectors
from dossier.plans import registry
from dossier.sources import files as raw, tables, walk


@pytest.mark.parametrize("name,ext", [
    ("a.pdf", ".pdf"), ("A.KEY", ".key"), (".bashrc", ""), ("noext", ""), ("a.tar.gz", ".gz"), ("x.", "")])
def test_extension(spark, name, ext):
    assert spark.createDataFrame([(name,)], "n string").select(rules.extension(F.col("n"))).first()[0] == ext


@pytest.mark.parametrize("ext,size,category,status", [
    (".key", 5, "Security", "KEEP"), (".KEY", 5, "Security", "REVIEW"), ("", 5, "Uncategorized", "REVIEW"),
    (".md5", 5, "Data", "DELETE_CANDIDATE"), (".pdf", 0, "Document", "DELETE_CANDIDATE"), (".pdf", 9, "Document", "KEEP"),
    (".zip", 9, "Archive", "ARCHIVE"), (".8bf", 9, "Image", "REVIEW"), (".20240131", 9, "Uncategorized", "REVIEW"),
    (".jspx", 9, "Code", "REVIEW"), (".unknown", 9, "Uncategorized", "REVIEW"),
])
def test_category_and_status(spark, ext, size, category, status):
    rows = spark.createDataFrame([(ext, size)], "extension string, size_bytes long")
    row = inventory.inventory_status(inventory.categorize_extension(rows)).first()
    assert (row["category"], row["status"]) == (category, status)


KNOWN_EXTENSIONS = {
    "Document": (
        ".pdf .docx .doc .txt .rtf .odt .md .tex .wps .wpd .pages .epub .mobi .djvu .wri .cnt .diz .nfo .onetoc2 "
        ".license"
    ),
    "Presentation": (
        ".pptx .ppt .odp .ppsx .pps"
    ),
    "Security": (
        ".key .pem .crt .cer .p12 .pfx .pub .rsa .sf .pk8 .der .keystore .password"
    ),
    "Spreadsheet": (
        ".xlsx .xls .csv .ods .tsv .numbers .xlsm"
    ),
    "Image": (
        ".jpg .jpeg .png .gif .bmp .tiff .tif .webp .svg .ico .heic .heif .raw .cr2 .nef .psd .ai .eps .xcf .cur "
        ".ani .skin .hdr .psp .icm .icc .cel .aco .acb .acv .atn .grd .pat .abr .asl .ahu .alv .blw .pqg .csf "
        ".dbrush .dbrsb .8bf .8bi .8bx .8ba .8be .8me .8li .exv"
    ),
    "Video": (
        ".mp4 .avi .mov .mkv .wmv .flv .webm .m4v .mpeg .mpg .3gp .ts .vob .rmvb"
    ),
    "Audio": (
        ".mp3 .wav .flac .aac .ogg .wma .m4a .opus .aiff .mid .midi .au"
    ),
    "Archive": (
        ".zip .rar .7z .tar .gz .bz2 .xz .cab .iso .tgz .z"
    ),
    "Executable": (
        ".exe .msi .apk .app .dmg .deb .rpm .run .bat .cmd .com .swf .msu .msp .pkg .comppk"
    ),
    "System": (
        ".dll .sys .drv .so .bin .dat .img .rom .bios .efi .mui .vxd .ovl .hlp .chm .ntf .mnu .cpi .pif .mbr .vfd "
        ".sdb .hiv .dos .icl .inx .frp .mdl .gll .ilk .binary .ncb .pdb .tlb .lib .exp .dl_ .ex_ .nl_ .sy_ .fo_ "
        ".ap_ .bin_sts .irs"
    ),
    "Code": (
        ".csh .html .htm .css .js .jsx .tsx .php .asp .aspx .vue .svelte .scss .less .xsl .xsd .tld .xhtml .shtml "
        ".coffee .ashx .master .webinfo .csproj .resx .script .py .java .c .cpp .cc .cxx .h .hpp .cs .go .rs .rb "
        ".swift .kt .scala .r .m .pl .lua .dart .vb .asm .f90 .pas .sh .bash .zsh .fish .ps1 .psm1 .vbs .jar "
        ".class .dex .aidl .war .ejb .gradle .pom .mf .jsp .jspx .jspf .sln"
    ),
    "Data": (
        ".json .xml .yaml .yml .toml .parquet .xyz .tab .ado .md5 .rpt .lst .ins .lid .sif .vce .dir .act .zvt "
        ".p3r .p3l .p3m .p3e .ple .iros .slc .rtc .eap .ilm .flp .eve .cha .hdt .whs .apl .mfm .shc .kys .rw "
        ".enumerated .sp3"
    ),
    "Config": (
        ".ini .conf .cfg .env .properties .reg .plist .config .prefs .policy .manifest .inf .adm .pro .lang "
        ".strings .store .info .sitemap .jdbc .tpl .map .tag .refresh .lookup .mappings .access .marker .component "
        ".exsd .e4xmi .iml .suo .vsmdi .vspscc .vssscc .user .settings .ppd .slf .lock .exclude .oem .pdsync "
        ".pdsyncu"
    ),
    "Database": (
        ".sql .db .sqlite .sqlite3 .mdb .accdb .dbf .mdf .ldf .sdf .wdb .dbd"
    ),
    "Font": (
        ".ttf .otf .woff .woff2 .eot .fon"
    ),
    "3D": (
        ".obj .fbx .stl .blend .dae .3ds"
    ),
    "CAD": (
        ".dwg .dxf .step .stp .iges .drw"
    ),
    "Temp": (
        ".tmp .temp .cache"
    ),
    "Log": (
        ".log"
    ),
    "Backup": (
        ".bak .old .orig .v20150204-1700 .201503100339-release-e44 .24022014"
    ),
    "Shortcut": (
        ".lnk .url .desktop .webloc"
    ),
    "VirtualMachine": (
        ".vmdk .vhd .vhdx .ova .ovf .qcow2"
    ),
}


def test_every_known_extension_has_its_category(spark):
    """Against a literal list that is not made from ``fixed``."""
    want = {e: c for c, listed in KNOWN_EXTENSIONS.items() for e in listed.split()}
    rows = spark.createDataFrame([(e,) for e in want], "extension string")
    got = {r["extension"]: r["category"] for r in inventory.categorize_extension(rows).collect()}
    assert got == want and len(want) == 398


def test_own_mapping_overrides_and_extends(spark):
    rows = spark.createDataFrame([(".pdf",), (".abc",), (".txt",)], "extension string")
    own = spark.createDataFrame([(".abc", "Data"), (".pdf", "Image")], "extension string, category string")
    got = {r[0]: r[1] for r in inventory.categorize_extension(rows, own).select("extension", "category").collect()}
    assert got == {".pdf": "Image", ".abc": "Data", ".txt": "Document"}


def test_a_mapping_adds_to_the_built_in_list(spark):
    known = " ".join(fixed.EXTENSIONS_OF_CATEGORY.values()).split()
    assert len(known) == len(set(known)) == 398 and all(e == e.lower() and e[0] == "." for e in known)
    more = spark.createDataFrame([(".8BX", "Data"), (".20240131", "Backup")], "extension string, category string")
    rows = spark.createDataFrame([(".8bf",), (".8bx",), (".20240131",), (".pdf",)], "extension string")
    got = {r["extension"]: r["category"] for r in inventory.categorize_extension(rows, more).collect()}
    assert got == {".8bf": "Image", ".8bx": "Data", ".20240131": "Backup", ".pdf": "Document"}


@pytest.mark.parametrize("ext,category,route", [
    (".tmp", "Temp", "skip"), (".bat", "Executable", "skip"), (".txt", "Document", "text"), (".tsv", "Spreadsheet", "csv"),
    (".key", "Security", "text"), (".jar", "Code", "jar"), (".zip", "Archive", "archive"), (".7z", "Archive", "skip"),
    (".class", "Code", "binary_strings"), (".reg", "Config", "text"), (".svg", "Image", "generic"), (".pages", "Document", "doc"),
])
def test_route(spark, ext, category, route):
    rows = spark.createDataFrame([(ext, category)], "extension string, category string")
    assert extract.extraction_route(rows).first()["route"] == route


@pytest.mark.parametrize("text,method,ext,status", [
    ("abc", "TIMEOUT", ".txt", "SKIPPED"), ("", "plain", ".txt", "FAILED"), (None, "plain", ".txt", "FAILED"),
    ("x" * 19, "tesseract_ocr", ".png", "PARTIAL"), ("x" * 20, "tesseract_ocr", ".png", "SUCCESS"),
    ("x" * 9, "pdf", ".pdf", "PARTIAL"), ("x", "plain", ".txt", "SUCCESS"),
])
def test_extraction_status(spark, text, method, ext, status):
    rows = spark.createDataFrame([(text, method, ext)], "extracted_text string, extraction_method string, extension string")
    assert extract.extraction_status(rows).first()["extraction_status"] == status


def files(spark, rows):
    return spark.createDataFrame(rows, "hash string, path string")


def test_exact_groups(spark):
    rows = [("h", "b"), ("h", "a"), ("h", "c"), ("h", "a"), (None, "x"), (None, "y"), ("error_permission", "p"),
            ("error_permission", "q"), ("solo", "z"), ("twice", "same"), ("twice", "same")]
    pairs = {tuple(r) for r in dedup.exact_duplicate_pairs(files(spark, rows)).collect()}
    assert pairs == {("h", "a", "b"), ("h", "a", "c")}
    assert {r["copies"] for r in dedup.exact_duplicate_groups(files(spark, rows)).collect()} == {3}


def test_a_hot_hash_gives_linear_pairs(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash"),
        F.format_string("p%05d", "id").alias("path"))
    assert dedup.exact_duplicate_pairs(rows).count() == 999


def test_redundancy(spark):
    pairs = spark.createDataFrame(
        [("1_0", "2_0", 0.8), ("2_1", "1_1", 0.9), ("1_0", "9_0", 0.99), ("1_0", "1_1", 0.97), ("8_0", "9_0", 0.9)],
        "chunk_id_1 string, chunk_id_2 string, similarity_score double")
    paths = spark.createDataFrame([("1_0", "a"), ("1_1", "a"), ("2_0", "b"), ("2_1", "b"), ("2_2", "b")],
                                  "chunk_id string, path string")
    sections = dedup.chunk_to_path_map(pairs, paths)
    got = {(r["path_1"], r["path_2"]): r for r in dedup.file_redundancy(sections, paths).collect()}
    assert set(got) == {("a", "b"), ("", "a")}
    assert got["a", "b"]["shared_chunks"] == 2
    assert got["a", "b"]["avg_similarity"] == pytest.approx(0.85)
    assert got["a", "b"]["redundancy_ratio"] == pytest.approx(2 / 3)
    assert got["", "a"]["action"] == "DELETE duplicate"


def test_redundancy_counts_every_pair_of_copies(spark, monkeypatch):
    """Files share chunks first held by others; a near link holds for every copy; against all chunk pairs."""
    monkeypatch.setattr(dedup, "BLOCK_FILES", 2)
    e = [[1.0, 0.0, 0.0], [0.96, 0.28, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]]
    files = {"a": [0, 1, 2], "b": [0, 2, 4], "c": [0, 0, 3, 4], "d": [1, 3], "e": [0, 1], "f": [2], "g": [2, 3, 3]}
    rows = [(f"{path}_{i}", path, e[v]) for path, held in files.items() for i, v in enumerate(held)]
    table = spark.createDataFrame(rows, "chunk_id string, path string, vector array<double>")
    want = {}
    for i, (_, p, v) in enumerate(rows):
        for _, q, w in rows[i + 1:]:
            if p != q and (score := sum(x * y for x, y in zip(v, w))) >= 0.9:
                want.setdefault((p, q), []).append(score)
    got = {(r["path_1"], r["path_2"]): r for r in dedup.class_redundancy(
        vectors.near_duplicate_pairs(table, 0.9), vectors.class_members(table), table.select("chunk_id", "path")).collect()}
    assert set(got) == set(want) and ("f", "g") in got
    for pair, scores in want.items():
        assert got[pair]["shared_chunks"] == len(scores)
        assert got[pair]["avg_similarity"] == pytest.approx(sum(scores) / len(scores))
        assert got[pair]["redundancy_ratio"] == pytest.approx(len(scores) / max(len(files[p]) for p in pair))


def test_paths_and_their_pairs_without_the_pair_table(spark, monkeypatch):
    """Random classes, links and unknown paths: the stored form gives what the whole pair table does."""
    monkeypatch.setattr(dedup, "BLOCK_FILES", 3)
    rng = random.Random(6)
    basis = [[float(i == j) for j in range(6)] for i in range(6)]
    basis += [[0.96 * x + 0.28 * y for x, y in zip(basis[0], basis[1])], [0.95 * x + 0.3122499 * y for x, y in zip(basis[2], basis[3])]]
    rows = [(f"{i}", rng.choice(["", None, *(f"p{k}" for k in range(14))]), basis[rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 7])]) for i in range(40)]
    rows += [("own0", "alone", [0.0, 0.6, 0.0, 0.0, 0.8, 0.0]), ("own1", "alone", [0.0, 0.6, 0.0, 0.0, 0.8, 0.0]), ("zero", "z", [0.0] * 6)]
    table = spark.createDataFrame(rows, "chunk_id string, path string, vector array<double>")
    paths = table.select("chunk_id", "path")
    pairs, members = vectors.near_duplicate_pairs(table, 0.9).cache(), vectors.class_members(table)
    whole = dedup.class_redundancy(pairs, members, paths, 0.85).cache()
    held = dedup.class_files(members, paths).cache()
    links = dedup.class_links(pairs, held).cache()
    exact = spark.createDataFrame([("h", "x1", "x2")], "hash string, path_1 string, path_2 string")
    fast = dedup.class_duplicate_paths(exact, held, links, paths)
    assert {r[0] for r in fast.collect()} == {r[0] for r in dedup.duplicate_paths(exact, whole).collect()} > {"x1", "x2"}
    assert "alone" not in {r[0] for r in fast.collect()}
    slow = dedup.class_duplicate_paths(exact, held, links, paths, 0.90, 0.97)
    general = dedup.class_redundancy(pairs, members, paths, 0.97)
    assert {r[0] for r in slow.collect()} == {r[0] for r in dedup.duplicate_paths(exact, general).collect()}
    asked = spark.createDataFrame([("p3",), ("p5",), ("p3",), ("",), ("nowhere",)], "path string")
    got = dedup.redundancy_of_paths(asked, held, links, paths).collect()
    want = whole.filter("path_1 IN ('p3', 'p5', '') OR path_2 IN ('p3', 'p5', '')").collect()
    plain = lambda found: {(r["path_1"], r["path_2"]): (r["shared_chunks"], round(r["avg_similarity"], 9), round(r["redundancy_ratio"], 9),
                                                       r["action"]) for r in found}
    assert len(got) == len(want) > 10 and plain(got) == plain(want)
    assert dedup.linked_paths(held.filter("false"), links.filter("false")).count() == 0


def test_marking_paths_makes_rows_in_proportion(spark):
    """A class of n files: joins give rows per file, not per pair."""
    held = spark.range(3000).select(F.lit("c").alias("class_id"), F.format_string("p%d", "id").alias("path"), F.lit(1).cast("long").alias("n"))
    links = spark.createDataFrame([], "class_1 string, class_2 string, similarity double")
    marked = dedup.linked_paths(held, links)
    assert marked.count() == 3000
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_ratio_may_exceed_one_and_average_on_the_edge_deletes(spark):
    sections = spark.createDataFrame([("a", "b", 0.85)] * 3, "path_1 string, path_2 string, similarity double")
    paths = spark.createDataFrame([("1_0", "a"), ("2_0", "b")], "chunk_id string, path string")
    row = dedup.file_redundancy(sections, paths).first()
    assert row["redundancy_ratio"] == 3.0
    assert row["action"] == ("DELETE duplicate" if row["avg_similarity"] >= 0.85 else "REVIEW")


def signal_rows(spark, rows):
    schema = "file_id long, " + ", ".join(f"{s} double" for s in fixed.SIGNALS)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_weights_sum_to_one():
    assert sum(fixed.SIGNAL_WEIGHTS) == pytest.approx(1.0)


def test_boot_score_of_constant_signals_is_not_rescaled(spark):
    rows = signal_rows(spark, [[0.5] * 9] * 3)
    assert {round(r["boot_score"], 6) for r in score.boot_score(rows).collect()} == {50.0}


@pytest.mark.parametrize("value,label", [
    (0.0, "DELETE_CANDIDATE"), (19.99, "DELETE_CANDIDATE"), (20.0, "REVIEW"), (50.0, "ARCHIVE"), (80.0, "KEEP"), (100.0, "KEEP")])
def test_label_edges(spark, value, label):
    assert spark.range(1).select(rules.score_label(F.lit(value))).first()[0] == label


@pytest.mark.parametrize("modified,accessed,want", [
    (None, None, 0.0), ("2026-01-01 00:00:00", None, 1.0), ("2000-01-01 00:00:00", None, 0.0),
    ("2000-01-01 00:00:00", "2025-12-31 00:00:01", 1.0), ("2025-12-30 00:00:00", None, 1 - 2 / 1825),
    ("2026-01-11 00:00:00", None, 1 + 10 / 1825),
])
def test_recency(spark, modified, accessed, want):
    rows = spark.createDataFrame([(modified, accessed)], "m string, a string").select(
        F.col("m").cast("timestamp_ntz").alias("modified_time"), F.col("a").cast("timestamp_ntz").alias("access_time"))
    assert score.s_recency(rows, "2026-01-01 00:00:00").first()["s_recency"] == pytest.approx(want)


def test_depth_without_chunks_is_zero(spark):
    rows = spark.createDataFrame([(None,), (20,), (100,)], "chunk_total long")
    assert [r[0] for r in score.s_content_depth(rows).select("s_content_depth").collect()] == [0.0, 1.0, 1.0]


def test_histograms(spark):
    scores = spark.createDataFrame([(0.0,), (20.0,), (50.0,), (80.0,), (100.0,), (None,)], "importance_score double")
    equal = [r["files"] for r in report.score_histogram_equal(scores).collect()]
    assert equal == [2, 0, 1, 0, 0, 1, 0, 0, 1, 1]
    assert [r["files"] for r in report.score_histogram_tiers(scores).collect()] == [2, 1, 1, 1]
    assert [r["files"] for r in report.score_histogram_tiers(scores, include_max=True).collect()] == [2, 1, 1, 2]


def test_signal_ties(spark):
    rows = signal_rows(spark, [[0.0] * 9]).withColumn("attribution", F.array(*[F.lit(0.5)] * 9))
    row = explain.weak_signals(explain.top_signals(rows)).first()
    assert [s["signal"] for s in row["top_signals"]] == list(fixed.SIGNALS[::-1][:3])
    assert [s["signal"] for s in row["weak_signals"]] == list(fixed.SIGNALS[:4])


@pytest.mark.parametrize("value", [42.25, 42.45, 42.35, 0.05, 0.15, 99.95, 7.0, 33.33, 12.75, 18.65])
def test_one_decimal_rounds_like_printf(spark, value):
    text = spark.range(1).select(F.format_string("%.1f", explain.one_decimal(F.lit(value)))).first()[0]
    assert text == f"{value:.1f}"


def test_validate_feedback(spark):
    rows = spark.createDataFrame([(" keep ", "approve"), ("KEEP", "maybe"), ("nothing", "REJECT"), (None, None)],
                                 "human_label string, decision string")
    valid, rejected = feedback.validate_feedback(rows)
    assert [tuple(r) for r in valid.collect()] == [("KEEP", "APPROVE", 3)]
    assert rejected.count() == 3
    given = rows.withColumn("reviewer_confidence", F.lit(None).cast("int"))
    assert feedback.validate_feedback(given)[0].first()["reviewer_confidence"] is None


def test_newest_feedback_masks_an_older_certain_one(spark):
    rows = spark.createDataFrame(
        [(1, 7, 5, 0, "2025-01-01"), (2, 7, 1, 0, "2025-02-01"), (3, 8, None, None, "2025-01-01"),
         (4, 9, 5, 2, "2025-01-01"), (5, 10, 5, 3, "2025-01-01")],
        "feedback_id long, file_id long, reviewer_confidence int, training_attempts int, created_at string")
    assert {r["file_id"] for r in feedback.usable_feedback(rows).collect()} == {8, 9}


def test_class_balance(spark):
    rows = spark.createDataFrame([("KEEP",)] * 5 + [("REVIEW",)] * 4, "human_label string")
    assert [tuple(r) for r in feedback.class_balance_check(rows).collect()] == [("REVIEW", 4)]


def test_split_is_exact_and_stratified(spark):
    rows = spark.range(1003).select(F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, "KEEP").otherwise("REVIEW").alias("human_label"))
    got = feedback.stratified_split(rows).groupBy("human_label").agg(
        F.count("*").alias("n"), F.count_if("is_holdout").alias("held")).collect()
    assert {(r["n"], r["held"]) for r in got} == {(335, 67), (668, 134)}


def test_gate_score_counts_a_class_only_predicted(spark):
    rows = spark.createDataFrame([("KEEP", "KEEP"), ("KEEP", "REVIEW")], "t string, p string")
    keep_f1, weights = 2 / 3, (2.0, 2.5 / 3)
    assert feedback.gate_score(rows, "t", "p").first()[0] == pytest.approx(keep_f1 * weights[0] / sum(weights))


@pytest.mark.parametrize("new,old,force,want", [
    (0.8, 0.79, False, True), (0.795, 0.79, False, False), (0.1, 0.0, False, True), (0.1, 0.9, True, True)])
def test_promotion(spark, new, old, force, want):
    candidate = spark.createDataFrame([(new,)], "gate_score double")
    baseline = spark.createDataFrame([(old,)], "gate_score double")
    assert feedback.promotion_decision(candidate, baseline, force=force).first()["promoted"] is want


def test_probabilities_of_three_classes_are_padded(spark):
    rows = spark.createDataFrame([([0.0, 0.2, 0.8, 0.0],)], "probability array<double>")
    row = model.score_from_probabilities(rows).first()
    assert (row["importance_score"], row["label"], row["confidence"]) == (59.0, "ARCHIVE", 0.8)


def test_shapley_equals_its_definition(spark):
    from itertools import combinations
    from math import factorial

    import numpy as np
    from pyspark.ml.linalg import Vectors

    values = np.random.default_rng(3).random((60, 9))
    rows = signal_rows(spark, values.tolist()).withColumn(
        "boot_label", F.when(F.col("s_recency") > 0.5, "KEEP").otherwise("REVIEW"))
    forest = model.train_importance_model(rows, trees=3, depth=3)
    got = {r["file_id"]: r["attribution"] for r in model.attribution_shapley(rows, forest).collect()}
    mean = values.mean(axis=0)
    x = values[5]
    worth = {}
    for k in range(10):
        for present in combinations(range(9), k):
            mixed = mean.copy()
            mixed[list(present)] = x[list(present)]
            worth[present] = np.resize(np.append(forest.predictProbability(Vectors.dense(mixed)).toArray(), [0] * 4), 4)
    for i in range(9):
        total = np.zeros(4)
        for present, p in worth.items():
            if i not in present:
                weight = factorial(len(present)) * factorial(8 - len(present)) / factorial(9)
                total += weight * (worth[tuple(sorted(present + (i,)))] - p)
        assert got[5][i] == pytest.approx(np.abs(total).mean(), abs=1e-9)


def test_a_forest_in_parts_equals_sparks_forests(spark, monkeypatch, tmp_path):
    """Probabilities are those of Spark's own parts, weighted by their trees; a saved forest comes back."""
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier

    from dossier.operators import forest as parts

    asked = []

    class Watched(RandomForestClassifier):
        def fit(self, rows):
            asked.append(super().fit(rows))
            return asked[-1]

    monkeypatch.setattr(parts, "RandomForestClassifier", Watched)
    monkeypatch.setattr(parts, "PART", 4)
    values = np.random.default_rng(9).random((200, 9))
    rows = signal_rows(spark, values.tolist()).withColumn(
        "boot_label", F.when(F.col("s_recency") + F.col("s_uniqueness") > 1.2, "KEEP").when(F.col("s_llm_quality") > 0.6, "ARCHIVE").otherwise("REVIEW"))
    grown = model.train_importance_model(rows, trees=10, depth=5)
    assert [m.getNumTrees for m in asked] == [4, 4, 2] and len(grown.trees) == 10
    assert len({t.threshold.tobytes() for t in grown.trees}) == 10  # parts differ
    want = np.zeros((200, 4))
    assembled = model.features(rows)
    for m in asked:
        p = np.array([r["probability"].toArray() for r in m.transform(assembled).orderBy("file_id").collect()])
        want[:, :p.shape[1]] += m.getNumTrees * p / 10
    got = np.array([r["probability"] for r in model.probabilities(rows, grown).orderBy("file_id").collect()])
    assert np.allclose(got, want, atol=1e-12)
    importances = sum(m.getNumTrees * m.featureImportances.toArray() for m in asked) / 10
    assert np.allclose(grown.featureImportances.toArray(), importances)
    grown.save(spark, str(tmp_path / "f"))
    again = parts.load(spark, str(tmp_path / "f"))
    assert np.allclose(again.probabilities(values), want, atol=1e-12) and np.allclose(again.importances, grown.importances)
    empty = model.probabilities(rows.filter("false"), grown)
    assert empty.count() == 0 and dict(empty.dtypes)["probability"] == "array<double>"


def test_every_file_gets_shapley_values(spark):
    import random
    rng = random.Random(4)
    rows = signal_rows(spark, [[rng.random() for _ in range(9)] for _ in range(40)]).withColumns({
        "boot_label": F.when(F.col("s_recency") > 0.5, "KEEP").otherwise("REVIEW"),
        "importance_score": F.col("s_recency") * 100})
    forest = model.train_importance_model(rows, trees=3, depth=3)
    got = model.attributions(rows, forest).select("attribution").collect()
    assert len(got) == 40 and sum(r["attribution"][fixed.SIGNALS.index("s_recency")] for r in got) > 1
    assert model.attributions(rows, None).count() == 40


def test_archive_members(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("a/b/doc.TXT", "hello")
        archive.writestr("empty.pdf", "")
        archive.writestr("x.tmp", "t")
        archive.writestr("song.mp3", "m")
        archive.writestr("top.json", "{}")
    rows = spark.createDataFrame([("/r/z.zip", buffer.getvalue()), ("/r/bad.zip", b"not a zip")], "path string, content binary")
    got = {r["path"]: (r["name"], r["extension"], r["depth"], r["folder"], r["size_bytes"]) for r in raw.archive_members(rows, 1).collect()}
    assert got == {"/r/z.zip::a/b/doc.TXT": ("doc.TXT", ".txt", 4, "/r/z.zip::a/b", 5),
                   "/r/z.zip::top.json": ("top.json", ".json", 2, "/r/z.zip::.", 2)}


def test_walk_tells_what_it_cannot_read(spark, tmp_path, monkeypatch):
    assert list(walk._entries(str(tmp_path / "gone"))) == [(str(tmp_path / "gone"), False, None, None, None, None, "error_not_found")]
    row = walk.walk_inventory(spark, str(tmp_path / "gone")).first()
    assert row["hash"] == "error_not_found" and row["size_bytes"] is None and row["status"] == "REVIEW"


def test_scan_and_walk_read_nested_files(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "sub" / "deep" / "b.txt").write_bytes(b"")
    (tmp_path / "sub" / "c.TXT").write_bytes(b"yy")
    columns = ("name", "depth", "status", "hash", "size_bytes", "folder")
    scanned = {tuple(r) for r in raw.scan_inventory(spark, str(tmp_path)).select(*columns).collect()}
    walked = {tuple(r) for r in walk.walk_inventory(spark, str(tmp_path)).select(*columns).collect()}
    assert {r[0] for r in walked} == {"a.pdf", "b.txt", "c.TXT"}
    assert scanned == {r for r in walked if r[4] > 0}  # Spark lists no empty files
    by_name = {r[0]: r for r in walked}
    assert by_name["a.pdf"][1:3] == (0, "KEEP") and by_name["c.TXT"][1:3] == (1, "REVIEW")
    assert by_name["b.txt"][1:3] == (2, "DELETE_CANDIDATE")
    assert walk.walk_inventory(spark, str(tmp_path)).filter("access_time IS NULL").count() == 0
    assert raw.scan_inventory(spark, str(tmp_path), with_hash=False).filter("hash IS NULL").count() == 2


def test_full_inventory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "good.zip", "w") as archive:
        archive.writestr("a/doc.txt", "hello")
    (tmp_path / "in" / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "x.mp3").write_bytes(b"m")
    (tmp_path / "y.txt").write_bytes(b"t")
    kept, held = raw.full_inventory(spark, str(tmp_path))
    root = str(tmp_path)
    assert {(r["path"].replace(root, ""), r["depth"]) for r in kept.collect()} == {
        ("/in/good.zip", 1), ("/in/good.zip::a/doc.txt", 3), ("/y.txt", 0)}
    assert {(r["name"], r["reason"]) for r in held.collect()} == {
        ("bad.zip", "unreadable_archive"), ("x.mp3", "category:Audio")}


def test_unreadable_files_get_an_error_code(spark):
    rows = spark.createDataFrame([("/nowhere/at/all",)], "path string")
    assert walk.hash_files(rows).first()["hash"] == "error_not_found"


@pytest.mark.parametrize("content,ext,binary", [
    (b"\x00\x01\x02abc", ".bin", True), (b"\x00\x01\x02abc", ".txt", False), (b"plain text", ".bin", False), (b"", ".bin", False),
    (b"a" * 8192 + b"\x00" * 99999, ".bin", True)])
def test_binary_guard(spark, content, ext, binary):
    rows = spark.createDataFrame([(content, ext)], "content binary, extension string")
    assert raw.binary_guard(rows).first()["is_binary"] is binary
    assert raw.binary_guard(rows, first_bytes=8192).first()["is_binary"] is (binary and len(content) < 8192)


def test_text_source_replaces_bad_bytes(spark):
    rows = spark.createDataFrame([(b" ok \xff end\n",)], "content binary")
    assert raw.text_source(rows).first()["text"] == "ok � end"


def test_printable_strings(spark):
    rows = spark.createDataFrame([(b"\x00abcd\x01xy\xffefghi",)], "content binary")
    assert raw.printable_strings(rows).first()["text"] == "abcd\nefghi"


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, n long")
    merged = {tuple(r) for r in tables.upsert_by_key(old, new, "k", "n").collect()}
    assert merged == {(1, "a", 0), (2, "d", 2), (3, "e", 1)}
    partial = {tuple(r) for r in tables.upsert_by_key(old, new, "k", "n", update=("v",)).collect()}
    assert partial == {(1, "a", 0), (2, "d", 0), (3, "e", 1)}
    assert {tuple(r) for r in tables.insert_ignore(old, new, ["k"], "n").collect()} == {(3, "e", 1)}
    assert tables.insert_ignore(old, new, ["k", "v"], "n").count() == 3


def test_csv_quoting(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi", you', None, 2621440)], "name string, label string, size_bytes long")
    path = str(tmp_path / "out")
    tables.export_csv(rows.coalesce(1), {"Name": "name", "Status": "label", "Size (MB)": tables.size_in_mb()}, path)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 'Name,Status,Size (MB)\n"say ""hi"", you",,2.5\n'


def test_session_history_is_oldest_first(spark):
    rows = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(10)], "session_id long, message_id long, role string, content string")
    got = sorted((r["position"], r["content"]) for r in serve.session_history(rows, 3).collect())
    assert got == [(1, "m7"), (2, "m8"), (3, "m9")]


def test_context_without_hits(spark):
    hits = spark.createDataFrame([], "query_id string, file_id long, relevance double")
    names = spark.createDataFrame([(1, "a")], "file_id long, name string")
    scores = spark.createDataFrame([(1, 5.0, "KEEP")], "file_id long, importance_score double, label string")
    chunks = spark.createDataFrame([(1, 0, "t", "SUCCESS")], "file_id long, chunk_index long, clean_text string, clean_status string")
    asked = spark.createDataFrame([("q",)], "query_id string")
    assert serve.retrieval_context(hits, names, scores, chunks, asked).first()["context"] == "No matching files were found."


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    old = spark.createDataFrame([(i, f"v{i}", 0, i % 3) for i in range(200)], "k long, v string, n long, extra long")
    tables.write_bucketed(old, path, "k", 16)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(3, "x", 1, None), (3, "y", 2, 7), (500, "z", 1, 8), (3, "w", 0, 9)], old.schema)
    touched = tables.upsert_buckets(spark, path, new, "k", "n", 16)
    after = files()
    gone = {f.split("/")[0] for f in before if after.get(f) != before[f]}
    assert 1 <= len(gone) <= touched <= 2 and len(set(before) & set(after)) >= len(before) * 13 // 16
    read = lambda: {tuple(r) for r in spark.read.parquet(path).select(*old.columns).collect()}
    want = {tuple(r) for r in tables.upsert_by_key(old, new, "k", "n").collect()}
    assert read() == want and (3, "y", 2, 7) in want
    tables.upsert_buckets(spark, path, new, "k", "n", 16)  # a repeated run changes nothing
    assert read() == want
    part = spark.createDataFrame([(4, "only", 5, 99), (501, "all", 5, 99)], old.schema)
    tables.upsert_buckets(spark, path, part, "k", "n", 16, update=("v",))
    assert {(4, "only", 0, 1), (501, "all", 5, 99)} <= read() and len(read()) == 202
    assert tables.upsert_buckets(spark, path, part.filter("false"), "k", "n", 16) == 0 and len(read()) == 202


def test_upsert_into_an_empty_bucketed_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (None, "b", 0)], "k long, v string, n long")
    tables.write_bucketed(rows.filter("false"), str(tmp_path / "t"), "k", 4)
    tables.upsert_buckets(spark, str(tmp_path / "t"), rows, "k", "n", 4)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v", "n").collect()} == {(1, "a", 0), (None, "b", 0)}


def test_change_log_is_read_from_a_snapshot_and_few_batches(spark, tmp_path, monkeypatch):
    from dossier.streaming.feedback import ChangeLog, current_state

    target = str(tmp_path / "log")
    log = ChangeLog(spark, target, "k", every=10)
    want = {}

    def save(n):
        rows = [(k, n * 100 + k) for k in (n % 7, n % 5 + 20)]
        want.update(rows)
        log.save(spark.createDataFrame(rows, "k long, v long").coalesce(1), n)

    for n in range(100):
        save(n)
    assert log.snapshot() == 99 and len(log._parts()) == 1
    for n in range(100, 105):
        save(n)
    assert len(log._parts()) == 6 and len(log.state().inputFiles()) <= 5 + 8 * 2
    read = lambda: {tuple(r) for r in current_state(spark, target, "k").collect()}
    assert read() == set(want.items())
    assert len(list(Path(target).glob("batch=*"))) <= 25 and len(list(Path(target, "_snapshots").glob("upto=*"))) == 2
    # The run dies after a snapshot is written and before its manifest is: nothing is lost, and the repeated batch goes on.
    for n in range(105, 109):
        save(n)
    with monkeypatch.context() as broken:
        broken.setattr(ChangeLog, "_name", lambda self, batch: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            save(109)
    assert log.snapshot() == 99 and read() == set(want.items())
    Path(target, "_manifests", "109").write_text('{"upto"')  # or while it is
    assert log.snapshot() == 99 and read() == set(want.items())
    save(109)
    assert log.snapshot() == 109 and read() == set(want.items()) and len(log._parts()) == 1
    save(109)
    assert read() == set(want.items())


def test_streamed_latest_equals_batch_over_several_batches(spark, tmp_path):
    from dossier.operators.keyed import latest_per_key
    from dossier.streaming import feedback as stream

    rows = spark.range(400).select(
        (F.col("id") % 17).alias("file_id"), F.col("id").alias("event_id"), (F.col("id") * 7 % 101).alias("ts"))
    source = str(tmp_path / "in")
    rows.repartition(8).write.parquet(source)
    stream.stream_feedback_latest(spark, source, spark.read.parquet(source).schema, str(tmp_path / "out"),
                                  str(tmp_path / "state"), files_per_batch=2).awaitTermination()
    got = {tuple(r) for r in stream.current_state(spark, str(tmp_path / "out"), "file_id").select(*rows.columns).collect()}
    assert got == {tuple(r) for r in latest_per_key(rows, "file_id", "ts", "event_id").collect()}


def test_stream_ingest_resumes(spark, tmp_path):
    from dossier.streaming import ingest

    schema = ("id long, file_id long, extracted_text string, extraction_method string, extraction_status string, "
              "language_hint string, phase1_status string")

    def batch(ids):
        return spark.createDataFrame([(i, i, f"text {i} " * 300, "markitdown", "SUCCESS", "en", "") for i in ids], schema)

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for ids in ((1, 2), (3,)):
        batch(ids).write.mode("append").parquet(source)
        ingest.stream_ingest(spark, source, spark.read.parquet(source).schema, target, state).awaitTermination()
    from dossier.operators import chunk
    want = {tuple(r) for r in chunk.chunk_documents(batch((1, 2, 3))).collect()}
    assert {tuple(r) for r in ingest.ingested(spark, target).select(*chunk.CHUNK_COLUMNS).collect()} == want


def test_stream_ingest_chunks_a_row_once(spark, tmp_path):
    """Rows come again in another file, in the same batch and after a restart."""
    from dossier.operators import chunk
    from dossier.streaming import ingest

    schema = ("id long, file_id long, extracted_text string, extraction_method string, extraction_status string, "
              "language_hint string, phase1_status string")

    def batch(ids):
        return spark.createDataFrame([(i, i or 0, f"text {i} " * 300, "markitdown", "SUCCESS", "en", "") for i in ids], schema)

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for ids in ((1, 2, 2), (2, 3, 1), (3, 4, None), (1, 4, None, 5)):
        batch(ids).coalesce(1).write.mode("append").parquet(source)
        ingest.stream_ingest(spark, source, spark.read.schema(schema).parquet(source).schema, target, state).awaitTermination()
    got = [tuple(r) for r in ingest.ingested(spark, target).select(*chunk.CHUNK_COLUMNS).collect()]
    want = {tuple(r) for r in chunk.chunk_documents(batch((1, 2, 3, 4, 5, None))).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_candidate_query_trains_the_forest_of_a_retraining_round(spark, monkeypatch):
    asked, train = [], model.train_importance_model

    def small(rows, label_col, trees, depth):
        asked.append((trees, depth))
        return train(rows, label_col, 2, 2)

    monkeypatch.setattr(model, "train_importance_model", small)
    registry.QUERIES["train_candidate"](spark, "/root/testdata/sf0.001")
    assert asked == [(model.TREES, model.DEPTH)]
