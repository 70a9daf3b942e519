import pytest

from brickledger import schemas
from brickledger.operators.cleaning import clean
from brickledger.plans import mart
from brickledger.sources import benchmarks, price_paid, tables
from brickledger.streaming.ingest import ingest_new_files

LINE = ('"{%s}","%d","%s-05-06 00:00","LS1 1AA","D","N","F","1, THE ""OLD"" MILL","","HIGH ST","","LEEDS","LEEDS",'
        '"WEST YORKSHIRE","A","A"\n')


@pytest.fixture()
def folder(tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for year in (2022, 2023):
        (landing / f"pp-{year}.csv").write_text("".join(LINE % (f"{year}-{i}", 100_000 + i, year) for i in range(5)))
    return landing


def test_reads_headerless_files_and_skips_absent_years(spark, folder):
    df = price_paid.read_years(spark, str(folder), [2021, 2022, 2023])
    assert df.schema == schemas.PRICE_PAID and df.count() == 10
    row = df.where("transaction_id = '{2022-0}'").first()
    assert row["paon"] == '1, THE "OLD" MILL' and row["price"] == 100_000 and row["saon"] is None


def test_no_files_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError):
        price_paid.read_years(spark, str(folder), [1995])


def test_mart_round_trip_prunes_years(spark, folder, tmp_path):
    properties = clean(price_paid.read_years(spark, str(folder), [2022, 2023]))
    path = mart.write_properties(properties, str(tmp_path / "mart"))
    stored = mart.read_properties(spark, path)
    assert sorted(map(str, stored.select(properties.columns).collect())) == sorted(map(str, properties.collect()))
    plan = stored.where("sale_year = 2022").select("price_gbp")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in plan and "ReadSchema: struct<price_gbp:bigint>" in plan


def test_csv_and_json_sinks(spark, folder, tmp_path):
    properties = schemas.conform(clean(price_paid.read_years(spark, str(folder), [2022])), schemas.PROPERTIES)
    path = tables.write_table(properties, str(tmp_path / "csv"), "csv")
    assert sorted(map(str, tables.read_table(spark, path, schemas.PROPERTIES, "csv").collect())) == sorted(
        map(str, properties.collect()))


def test_incremental_ingest_takes_each_file_once(spark, folder, tmp_path):
    def run():
        ingest_new_files(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "table")).count()

    assert run() == 10
    assert run() == 10
    (folder / "pp-2024.csv").write_text("".join(LINE % (f"2024-{i}", 200_000 + i, 2024) for i in range(3)))
    assert run() == 13


def test_benchmark_tables(spark):
    wide = {r["region"]: r for r in benchmarks.house_price_index(spark).collect()}
    assert len(wide) == 12 and wide["Scotland"]["avg_price_2024"] == 189000
    assert wide["North West"]["hpi_annual_change_2024_pct"] == 2.7
    long = benchmarks.house_price_index_long(spark).collect()
    assert len(long) == 72 and {r["sale_year"] for r in long} == set(range(2019, 2025))
    for r in benchmarks.school_outcomes(spark).collect():
        assert sum(v for v in r if isinstance(v, int)) == 100
    assert benchmarks.school_outcomes_long(spark).count() == 48
