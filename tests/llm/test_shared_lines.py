import itertools
import random

from corpus_pipeline import lines
from deckloom.llm.line_dedup import paired

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(rows)], SCHEMA)
    return [r.text for r in sorted(lines(spark, docs, "").collect(), key=lambda r: r.doc_id)]


def test_copies_of_one_document_spare_no_line(spark):
    rows = [(f"body {k}\nLicence", f"site{k % 20}") for k in range(60)] + [("much copied\nLicence", f"site{k % 20}") for k in range(300)]
    assert cleaned(spark, rows) == [f"body {k}" for k in range(60)] + ["much copied"] * 300


def test_header_and_footer_go_together(spark):
    rows = [(f"Header\nMenu\nbody {k}\nFooter\nLegal", f"site{k % 12}") for k in range(12)]
    assert cleaned(spark, rows) == [f"body {k}" for k in range(12)]


def test_copies_add_no_documents_and_no_sites(spark):
    rows = [("a whole copy\nof two lines", f"site{k}") for k in range(30)]
    rows += [(f"House line\nown {k}", "house") for k in range(40)] + [("House line\nsyndicated", f"site{k}") for k in range(30)]
    assert cleaned(spark, rows) == [t for t, _ in rows]


def test_sites_that_share_all_their_documents(spark):
    rows = [(f"Shared\nbody {k}", f"site{j}") for k in range(10) for j in range(10)]
    assert cleaned(spark, rows) == [f"body {k}" for k in range(10) for _ in range(10)]


def test_best_pairing_like_all_choices():
    rng = random.Random(6)
    for _ in range(300):
        edges = list({(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(9))})
        best = max((n for n in range(6) if any(len({d for d, _ in c}) == len({s for _, s in c}) == n for c in itertools.combinations(edges, n))), default=0)
        assert all(paired(edges, n) == (best >= n) for n in range(1, 6))
