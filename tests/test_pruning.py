"""Only the files of cycles near to some profile are opened."""

import glob
from datetime import date

from brinelink.operators.match import build_matchups
from brinelink.sources.cycles import cycles_from_partitions
from brinelink.sources.readers import read_sat_obs
from brinelink.sources.writers import write_table
from tests.test_match import ARGO, SAT, argo_row, sat_row

DAYS = (3, 30, 55)


def test_files_of_other_cycles_are_never_opened(spark, tmp_path):
    root = str(tmp_path / "sat")
    rows = [sat_row(0.1 * i, 0.1, 24.0 * d, 35.0, 4 * d) for d in range(60) for i in range(5)]
    sat = spark.createDataFrame(rows, SAT).selectExpr("*", "'smap' as sensor")
    write_table(sat.repartition("cycle_date"), root, ["cycle_date", "cycle_hour"])
    argo = spark.createDataFrame([argo_row(0.0, 0.0, 24.0 * d, 35.2, 4 * d) for d in DAYS], ARGO)
    cycles = cycles_from_partitions(spark, root)
    assert cycles.count() == 60

    def run():
        found = build_matchups(argo, read_sat_obs(spark, root, "smap"), "smap", cycles, window=1)
        return sorted(map(str, found.collect()))

    whole = run()
    assert len(whole) == len(DAYS)
    near = {d + o for d in DAYS for o in (-1, 0, 1)}
    files = glob.glob(f"{root}/**/*.parquet", recursive=True)
    assert len(files) == 60
    damaged = 0
    for f in files:
        day = date.fromisoformat(f.split("cycle_date=")[1][:10])
        if (day - date(2024, 1, 1)).days not in near:
            with open(f, "wb") as out:
                out.write(b"no parquet")
            damaged += 1
    assert damaged == 60 - len(near)
    spark.catalog.refreshByPath(root)
    assert run() == whole
