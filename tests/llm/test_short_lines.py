from stopwise.llm.common import table

from . import test_line_dedup
from .helpers import docs_of


def brute(rows):
    return sorted((r[:3] for r in test_line_dedup.brute(rows)), key=str)


def found(spark, rows):
    return sorted(((d, n, gone) for d, n, gone, _ in test_line_dedup.found(docs_of(spark, rows))), key=str)


def test_equal_short_lines_stay_once(spark):
    from stopwise.llm import line_dedup as op

    rows = [(2, "Les.\n\n \nyes\nLes. \nno"), (1, "yes\nLes.\n\n \nno.\nyes"), (3, "no\nLes.\n\t\nna")]
    got = {r.doc_id: (r.text, r.n_removed) for r in op.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {1: ("yes\nLes.\n\n \nno.", 1), 2: ("\n \nLes. \nno", 2), 3: ("\t\nna", 2)}


def test_documents_like_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) < 3000").limit(70)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(d + 10**6, "Les.\n" + t[:9] + "\n" + t[:15]) for d, t in rows[:20]]
    assert found(spark, rows) == brute(rows)
