"""Small corpora, and a comparison of rows that doesn't mind their order."""

import glob
import os

import duckdb

from recordloom.functions.normalize import normalize_country, normalize_text

RECORD = "source int, entity_id string, row_pos long, name_norm string, name_key string, address_norm string, country_norm string"


def records(spark, rows):
    """From (id, name[, address[, country]])."""
    out = []
    for i, (entity, *rest) in enumerate(rows):
        name, address, country = (*rest, "", "")[:3] if len(rest) < 3 else rest
        norm = normalize_text(name)
        out.append((int(entity[1]), entity, i, norm, norm.replace(" ", ""), normalize_text(address), normalize_country(country)))
    return spark.createDataFrame(out, RECORD)


def truth_of(spark, s1_ids, pairs):
    rows = spark.createDataFrame([(s, t, int(t[1])) for s, t in pairs], "s1_id string, target_id string, source int")
    counts = [(s, i, sum(a == s for a, _ in pairs)) for i, s in enumerate(s1_ids)]
    return rows, spark.createDataFrame(counts, "s1_id string, row_pos long, n_true long")


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else round(v, 9) if isinstance(v, float) else v


def rows_of(df):
    return sorted(repr(plain([r[c] for c in sorted(df.columns)])) for r in df.collect())


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(plain([row[i] for i in order])) for row in got.fetchall())
