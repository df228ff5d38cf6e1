"""Deterministic cards of company details from the customer table, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kartoteka.functions.checks import INN_10, INN_11, INN_12


def weighted(value: str, weights: tuple[int, ...]) -> str:
    """SQL of an INN's check digit."""
    return "((" + " + ".join(f"{w} * cast(substr({value}, {i}, 1) as int)" for i, w in enumerate(weights, 1)) + ") % 11 % 10)"


_S = "cast({} as string)"

#: id and identifiers, right and wrong by the key's remainders.
IDS = f"""
select c_custkey as id, c_nationkey as nation,
  case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then substr(inn10, 1, 4) || ' ' || substr(inn10, 5, 6)
       when c_custkey % 7 = 0 then n11 || {_S.format(weighted("n11", INN_12))}
       when c_custkey % 5 = 0 then n9 || {_S.format("(cast(substr(inn10, 10, 1) as int) + 1) % 10")} else inn10 end as inn,
  case when c_custkey % 17 = 0 then '77010010' when c_custkey % 19 = 0 then null else '77' || lpad({_S.format("c_nationkey")}, 2, '0') || '01001' end as kpp,
  case when c_custkey % 9 = 0 then substr(o12, 1, 8) when c_custkey % 10 = 0 then o12 || {_S.format("(cast(o12 as bigint) % 11 % 10 + 1) % 10")}
       when c_custkey % 14 = 0 then o14 || {_S.format("cast(o14 as bigint) % 13 % 10")} else o12 || {_S.format("cast(o12 as bigint) % 11 % 10")} end as ogrn,
  case when c_custkey % 8 = 0 then '12' else '04' end || b7 as bik,
  case when c_custkey % 16 = 0 then '301028100000' else '407028100000' end || lpad({_S.format("c_custkey")}, 8, '0') as rs,
  '30101810400000000' || case when c_custkey % 6 = 0 then '999' else substr(b7, 5, 3) end as ks
from (select *, n9 || {_S.format(weighted("n9", INN_10))} as inn10, n10 || {_S.format(weighted("n10", INN_11))} as n11
  from (select *, '50' || substr(n9, 1, 8) as n10, '1027700' || lpad({_S.format("(c_custkey * 37) % 100000")}, 5, '0') as o12,
      '30450011600' || lpad({_S.format("c_custkey % 1000")}, 3, '0') as o14, lpad({_S.format("(c_custkey * 131) % 10000000")}, 7, '0') as b7
    from (select *, lpad({_S.format("(c_custkey * 7919 + 770000000) % 1000000000")}, 9, '0') as n9 from {{customer}}) a) b) c"""

#: id and a card's text; the name stands in the label's line or in the next.
CARDS = f"""
select id, 'Полное наименование организации:' || case when id % 3 = 1 then chr(10) else ' ' end || 'ООО Фирма ' || {_S.format("id")} || chr(10)
  || coalesce('ИНН: ' || inn || chr(10), '') || coalesce('КПП: ' || kpp || chr(10), '') || coalesce('ОГРН: ' || ogrn || chr(10), '')
  || 'Расчетный счет: ' || rs || chr(10) || 'Корр. счет: ' || ks || chr(10) || 'БИК: ' || bik || chr(10)
  || 'Банк: ПАО Банк ' || {_S.format("nation")} || chr(10)
  || 'Телефон: 8 (495) ' || lpad({_S.format("id % 1000")}, 3, '0') || '-' || lpad({_S.format("id % 100")}, 2, '0') || '-67' || chr(10)
  || 'E-mail: c' || {_S.format("id")} || '@example.ru' || chr(10) || 'Директор: Иванов Иван Иванович' as text
from ({IDS}) d"""

#: Text with the noise that normalisation removes.
NOISY = f"""
select id, '  Договор' || case when id % 2 = 0 then chr(160) else '  ' end || 'поставки' || chr(13) || chr(10) || 'товара' || '​' || ' и'
  || chr(10) || 'услуг' || chr(10) || '(далее) ' || chr(9) || chr(9) || 'конец.' || chr(10) || chr(10) || chr(10) || chr(10) || 'ИНН 77 12' || chr(9) || '34' || chr(7)
  || ' ОКПО 123 КПП' || case when id % 3 = 0 then repeat(' слово', 2100) else '' end || '  ' || chr(10) as text
from ({IDS}) d"""


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, IDS)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, CARDS)


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, NOISY)


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of the SQL over customers. These are few bytes each and become long texts, so they are dealt over all tasks first."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(sql, customer=customers)
