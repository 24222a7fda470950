"""All frames of a run get a tile, at the places and with the labels that the SQL gives."""

import duckdb

from stopwise.plans import registry


def test_every_frame_has_a_tile(spark, sf_dir):
    df = registry.QUERIES["contact_layout"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    want = con.execute(registry.ORACLES["contact_layout"])
    names = [c[0] for c in want.description]
    rows = sorted(tuple(r) for r in df.select(*names).collect())
    assert rows == sorted(want.fetchall())
    assert len(rows) == con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert len({(r[0], r[names.index("left")], r[names.index("top")]) for r in rows}) == len(rows)
