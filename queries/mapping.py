"""The plans' input tables, derived from the provided tables.

Each input is one SQL text over ``lineitem orders customer events``. The text is the same
for Spark and for the checking engine except for date helpers, so what the checks compare
is the plans, not this mapping. Months are the order or ship month folded onto the months
the plans look at; amounts are whole numbers and scores are multiples of 1/2048, so sums
do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.io import read, store, store_bucketed

TABLES = ["lineitem", "orders", "customer", "events"]


@dataclass(frozen=True)
class Dialect:
    table: Callable[[str], str]
    days_between: Callable[[str, str], str]  # (later, earlier)


SPARK = Dialect(lambda t: "{" + t + "}", lambda a, b: f"datediff({a}, {b})")
DUCK = Dialect(lambda t: t, lambda a, b: f"date_diff('day', CAST({b} AS DATE), CAST({a} AS DATE))")


def month_at(index: str, year: int = 2021, offset: int = 0) -> str:
    """First day of the ``index``-th month counted from January of ``year`` plus ``offset`` months."""
    i = f"(CAST({index} AS INT) + {offset})"
    return f"make_date({year} + CAST(floor({i} / 12) AS INT), CAST({i} % 12 AS INT) + 1, 1)"


def plus_days(date: str, days: str) -> str:
    return f"({date} + CAST({days} AS INT))"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS DOUBLE)"


def whole_text(expr: str) -> str:
    return f"CAST(CAST(floor({expr}) AS BIGINT) AS STRING)"


def _folded(date: str, months: int) -> str:
    return f"CAST((12 * (year({date}) - 1995) + month({date}) - 1) % {months} AS INT)"


def _lines(d: Dialect, months: int = 28) -> str:
    return f"(SELECT *, {_folded('l_shipdate', months)} AS mi FROM {d.table('lines')}) f"


def _orders(d: Dialect, months: int = 28) -> str:
    return f"""(SELECT o_custkey AS client, {_folded('o_orderdate', months)} AS mi,
        o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM {d.table('orders')}) f"""


def _account(d: Dialect, first: int, last: int) -> str:
    """One row per account and month in first..last, attributes as the two snapshot sources need them."""
    opened = plus_days(month_at("(client * 7 + (account % 10) * 11) % 28"), "client % 28")
    return f"""(SELECT client, account, mi, {month_at('mi')} AS mes,
        CASE WHEN account % 3 = 0 THEN '9999' ELSE {text('account % 50')} END AS branch,
        CASE WHEN account % 97 = 0 THEN 0.0 WHEN account % 211 = 0 THEN 50000.0
             ELSE {whole('max(o_totalprice)')} * 4 END AS cupo,
        CASE WHEN account % 19 = 17 THEN 'x' WHEN account % 19 = 18 THEN NULL ELSE {text('account % 19')} END AS job,
        CASE WHEN account % 211 = 0 THEN DATE '2022-09-15' ELSE {opened} END AS opened,
        CASE WHEN account % 211 = 0 THEN DATE '1990-05-05'
             ELSE make_date(CAST(1945 + client % 60 AS INT), CAST(client % 12 + 1 AS INT), CAST(client % 28 + 1 AS INT)) END AS born,
        sum({whole('l_extendedprice')}) - CASE WHEN account % 13 = 0 THEN 90000.0 ELSE 0.0 END AS l1,
        CASE WHEN account % 4 = 0 THEN sum({whole('l_extendedprice * l_discount')}) ELSE 0.0 END AS l2,
        CASE WHEN account % 5 = 0 THEN NULL ELSE sum({whole('l_extendedprice * l_tax')}) END AS l3,
        max(abs({d.days_between('l_shipdate', 'o_orderdate')}) % 120) AS mora,
        min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS situ,
        CASE WHEN account % 6 = 0 THEN NULL ELSE max(CAST(l_shipdate AS DATE)) END AS moved
      FROM {_lines(d)} WHERE mi BETWEEN {first} AND {last} GROUP BY client, account, mi) a"""


def sources(d: Dialect) -> dict[str, str]:
    """SQL text of every input."""
    contract = f"concat('00', {text('account')})"
    alternate = f"CASE WHEN account % 2 = 0 THEN concat('00', {text('account')}) ELSE concat('A', {text('account')}) END"
    corporate = f"concat('C', {text('client')})"
    score = lambda a, b: f"CAST((client * {a} + mi * {b}) % 1024 AS DOUBLE) / 2048"
    out: dict[str, str] = {}
    out["lines"] = f"""SELECT o_custkey AS client, o_custkey * 10 + l_linenumber % 2 AS account, o_totalprice, o_orderdate,
        l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
      FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey"""
    out["client_id_map"] = f"""SELECT {text('c_custkey')} AS id_cliente, concat('C', {text('c_custkey')}) AS id_corporativo
      FROM {d.table('customer')}"""
    out["client_master"] = f"""SELECT {text('c_custkey')} AS idcliente, concat('C', {text('c_custkey')}) AS idcorporativo
      FROM {d.table('customer')}"""
    out["fraud_clients_a"] = f"""SELECT c_custkey AS rut, {plus_days(month_at('(c_custkey * 5) % 28'), '10')} AS fecha_fraude
      FROM {d.table('customer')} WHERE c_acctbal < 0"""
    out["fraud_clients_b"] = f"""SELECT c_custkey AS id_cliente, {plus_days(month_at('(c_custkey * 11) % 28'), '3')} AS fecha_venta
      FROM {d.table('customer')} WHERE c_acctbal > 9000 OR c_acctbal < -900"""
    out["fin_transactions"] = f"""SELECT {text('event_id')} AS id_trx, concat('C', {text('user_id')}) AS cod_contraparte,
        ts AS fecha_informacion FROM {d.table('events')}"""
    out["fraud_transactions"] = f"""SELECT {text('event_id')} AS id_trx FROM {d.table('events')}
      WHERE event_type = 'error' AND value > 50"""
    out["fraud_contracts"] = f"""SELECT {text('c_custkey * 10')} AS contrato_final FROM {d.table('customer')} WHERE c_acctbal < 1000"""
    out["account_month_old"] = f"""SELECT mes AS fecha_foto, {contract} AS contrato, client AS id_cliente, branch AS centalta,
        cupo AS f_cupo, job AS coacti,
        CASE WHEN account % 101 = 0 THEN 'sin fecha' ELSE {text('opened')} END AS id_dia_aper, {text('born')} AS id_dia_nac,
        l1 AS f_saldeud, l2 AS f_salde_su, l3 AS f_ava_ocu, l1 + l2 AS f_saldo, CAST(mora AS BIGINT) AS mora_ac,
        CAST(situ AS BIGINT) AS id_situ, CASE WHEN account % 8 = 0 THEN {text('mes')} ELSE '' END AS id_dia_reneg,
        {text('moved')} AS id_dia_maxultmov, CASE WHEN situ = 3 THEN {text('mes')} ELSE NULL END AS id_dia_cast
      FROM {_account(d, 0, 17)}"""
    out["account_month"] = f"""SELECT CASE WHEN (account + mi) % 23 = 0 THEN {plus_days('mes', '14')} ELSE last_day(mes) END AS fechacarga,
        {contract} AS contrato, CASE WHEN account % 29 = 0 THEN NULL ELSE {alternate} END AS contratoalterno,
        client AS idcliente, branch AS centalta, cupo AS fcupo, job AS coacti, opened AS iddiaaper, born AS iddianac,
        l1 AS fsaldeud, l2 AS fsaldesu, l3 AS favaocu, l1 + l2 AS fsaldo, CAST(mora AS BIGINT) AS moraac,
        CAST(situ AS BIGINT) AS idsitu, CASE WHEN account % 8 = 0 THEN mes ELSE NULL END AS iddiareneg,
        moved AS iddiamaxultmov, CASE WHEN situ = 3 THEN mes ELSE NULL END AS iddiacast
      FROM {_account(d, 14, 27)}"""
    out["contract_blocks"] = f"""SELECT DISTINCT {alternate} AS contratoalterno,
        CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'Temporal' WHEN 1 THEN 'Fraude' WHEN 2 THEN 'Permanente'
             WHEN 3 THEN 'Robo' ELSE NULL END AS descripcionbloqueo,
        CASE WHEN l_linenumber = 7 THEN {plus_days(month_at('mi'), '9')} ELSE last_day({month_at('mi')}) END AS fechacarga
      FROM {_lines(d)} WHERE l_linestatus = 'F'"""
    out["card_events"] = f"""SELECT {alternate.replace('account', '(user_id * 10 + event_id % 2)')} AS contrato,
        {plus_days(month_at('0'), '(event_id * 7) % 850')} AS fechaoperacion,
        CAST(CASE WHEN event_type = 'error' THEN 96022 ELSE 1000 + event_id % 7 END AS BIGINT) AS tipofac,
        event_type AS destipfac FROM {d.table('events')}"""
    out["income_logic"] = f"""SELECT {month_at('mi', 2020, 10)} AS fecha_foto, client AS id_cliente,
        CASE WHEN client % 9 = 0 THEN NULL WHEN client % 10 = 0 THEN 0.0 ELSE {whole('max(o_totalprice)')} * 3 END AS renta_final,
        CASE WHEN client % 2 = 0 THEN 'Modelo' ELSE 'Declarada' END AS tipo_renta_final,
        CASE WHEN client % 3 = 0 THEN 0.0 ELSE {whole('min(o_totalprice)')} END AS renta_compras
      FROM {_orders(d, 30)} GROUP BY client, mi"""
    out["bureau_month"] = f"""SELECT {month_at('mi', 2020, 5)} AS fecha_foto, client AS id_cliente,
        {whole('sum(l_extendedprice) / 100')} AS linea_disp,
        sum(CASE WHEN l_returnflag <> 'A' THEN {whole('l_extendedprice / 20')} END) AS dconsumo,
        sum(CASE WHEN l_returnflag = 'N' THEN {whole('l_extendedprice / 50')} ELSE 0.0 END) AS dcomercial,
        CASE WHEN client % 7 = 0 THEN 0.0 ELSE sum({whole('l_extendedprice / 10')}) END AS dhipotecar
      FROM {_lines(d, 33)} GROUP BY client, mi"""
    out["preapproval_scores"] = f"""SELECT {month_at('mi', 2020, 9)} AS fecha_foto, client AS id_cliente,
        CASE client % 5 WHEN 0 THEN 'BANCARIZADO MAYOR 21' WHEN 1 THEN 'NO BANCARIZADO MAYOR 21'
             WHEN 2 THEN 'EXTRANJERO NO BANCARIZADO' WHEN 3 THEN 'MENOR 21' ELSE NULL END AS segmento,
        CASE WHEN client % 41 = 0 THEN NULL WHEN client % 43 = 0 THEN 1.25 ELSE {score(37, 11)} END AS prob_preaprobados
      FROM {_lines(d, 31)} GROUP BY client, mi"""
    out["preapproval_scores_restated"] = f"""SELECT {month_at('mi', 2021, 4)} AS fecha_foto, client AS id_cliente,
        CASE WHEN client % 47 = 0 THEN NULL WHEN client % 53 = 0 THEN 1.5 ELSE {score(53, 7)} / 2 END AS prob
      FROM {_lines(d, 24)} WHERE l_linestatus = 'F' GROUP BY client, mi"""
    out["mini_policy"] = f"""SELECT {month_at('mi', 2020, 10)} AS fechafoto, client AS idcliente,
        CASE WHEN client % 6 = 0 THEN 0 ELSE 1 END AS cumpleminipoliticabanco,
        CASE WHEN client % 8 = 0 THEN NULL ELSE 1 END AS cumpleminipoliticatarjeta,
        CASE WHEN max(o_totalprice) > 400000 THEN 0 ELSE 1 END AS cumpleminipoliticacomercial,
        CASE WHEN mi % 9 = 0 THEN NULL ELSE 1 END AS cumpleminipoliticaburo
      FROM {_orders(d, 29)} GROUP BY client, mi"""
    out["vehicles"] = f"""SELECT {corporate} AS num_rut, {plus_days(month_at('mi', 2020, 6), 'l_quantity % 28')} AS upload_dt,
        CASE l_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'null' WHEN 3 THEN concat(' ', {whole_text('l_extendedprice * 100')}, ' ')
             ELSE {whole_text('l_extendedprice * 100')} END AS vr_appraised_amt,
        CASE l_partkey % 7 WHEN 0 THEN 'MOTO' WHEN 1 THEN 'CAMIONETA' WHEN 2 THEN 'JEEP' WHEN 3 THEN 'STATION WAGON'
             WHEN 4 THEN 'LANCHA' ELSE 'AUTOMOVIL' END AS vr_type,
        CASE l_partkey % 30 WHEN 28 THEN NULL WHEN 29 THEN '1500' ELSE {text('1995 + l_partkey % 30')} END AS vr_year
      FROM {_lines(d, 20)} WHERE l_returnflag = 'N'"""
    out["real_estate_month"] = f"""SELECT client AS id_cliente, {plus_days(month_at('mi', 2020, 4), 'l_quantity % 28')} AS fecha_foto,
        {whole_text('l_extendedprice * 200')} AS avaluo_total FROM {_lines(d, 22)} WHERE l_returnflag = 'R'"""
    out["houses"] = f"""SELECT {corporate} AS nhr_owner_rut_id, {plus_days(month_at('mi', 2020, 6), 'l_quantity % 28')} AS upload_dt,
        {whole_text('l_extendedprice * 300')} AS nhr_prop_val_amt FROM {_lines(d, 20)} WHERE l_returnflag = 'A'"""
    out["preapproved_base"] = f"""SELECT client AS idcliente, {month_at('mi')} AS fechafoto,
        CASE WHEN max(o_orderstatus) = 'P' THEN 1 ELSE 0 END AS marcapreaprobadosbase FROM {_orders(d)} GROUP BY client, mi"""
    out["bureau_person"] = f"""SELECT {corporate} AS idcliente,
        make_date(CAST(1945 + client % 60 AS INT), CAST(client % 12 + 1 AS INT), CAST(client % 28 + 1 AS INT)) AS fechanacimiento,
        CASE WHEN max(o_orderstatus) = 'P' THEN 'E' WHEN client % 31 = 0 THEN NULL ELSE 'C' END AS nacionalidad,
        CASE WHEN client % 37 = 0 THEN {plus_days(month_at('client % 28'), '5')} ELSE NULL END AS fechadefuncion,
        {plus_days(month_at('mi', 2020, 9), 'client % 28')} AS fechacarga FROM {_orders(d, 31)} GROUP BY client, mi"""
    applied = plus_days(month_at("mi", 2020, 6), "o_orderkey % 28")
    out["application_log"] = f"""SELECT concat({text(applied)}, ' 10:', lpad({text('o_orderkey % 60')}, 2, '0'), ':00') AS dregistro,
        client AS idcliente, {text('o_orderkey')} AS nsolic, {text('o_orderkey % 2')} AS niacpreaprobado,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {text('o_orderkey % 2')} END AS aiafpreaprobado,
        concat('nodo', {text('o_orderkey % 9')}) AS aaevaleafnodename, o_orderpriority AS arsltdpolcategoria,
        CASE WHEN o_orderkey % 3 = 0 THEN '9999' ELSE '17' END AS niasosolicsucapert,
        CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE 'N' END AS aiprevmfirmaautoprev, {text(applied)} AS diaccocfecrenta,
        CASE WHEN o_orderkey % 4 = 0 THEN 'EVA' ELSE 'ALT' END AS ctiposolic,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {whole_text('o_totalprice * 5')} END AS niaprenta,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {whole('o_totalprice')} * 4 END AS rentpromprev,
        CAST(o_orderkey % 90 AS BIGINT) AS antprevision, CAST(o_orderkey % 4 AS BIGINT) AS numcotival,
        CASE WHEN o_orderkey % 50 = 0 THEN 'S' ELSE 'N' END AS aexctacastigada,
        CASE WHEN o_orderkey % 3 = 1 THEN {whole_text('o_totalprice * 100')} ELSE NULL END AS niapavaluopropiedad,
        CASE WHEN o_orderkey % 3 = 2 THEN {whole_text('o_totalprice * 20')} ELSE NULL END AS niaptasacionvehiculo,
        {text('1990 + o_orderkey % 33')} AS niapaniovehiculo, concat('clase', {text('o_orderkey % 5')}) AS iantecedentesdelasolicitudai,
        CASE o_orderkey % 5 WHEN 0 THEN 'CL' WHEN 1 THEN '152' WHEN 2 THEN '604' WHEN 3 THEN NULL ELSE 'CL' END AS anacionalidad,
        {applied} AS fechacarga, CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 2 END AS norigen
      FROM {_orders(d, 34)}"""
    for letter, flag in (("s", "A"), ("f", "N"), ("t", "R")):
        out[f"retail_spend_{letter}"] = f"""SELECT {month_at('mi', 2020, 10)} AS fecha_foto, client AS id_cliente,
            CASE WHEN client % 3 = 0 THEN 0.0 ELSE sum({whole('l_extendedprice')}) END AS monto_{letter}_12m
          FROM {_lines(d, 30)} WHERE l_returnflag = '{flag}' GROUP BY client, mi"""
    out["provision_pd"] = f"""SELECT {month_at('mi')} AS fechacarga, {contract} AS ctacontrato, {score(29, 13)} AS pdfinal
      FROM {_lines(d)} GROUP BY client, account, mi"""
    out["income_pilot"] = f"""SELECT {month_at('mi', 2022, 4)} AS fecha_foto, client AS id_cliente,
        {whole('max(o_totalprice)')} * 2 AS renta_modelo, CASE WHEN client % 2 = 0 THEN 1 ELSE 0 END AS flag_con_info,
        CASE WHEN client % 4 = 0 THEN NULL ELSE {whole('max(o_totalprice)')} * 4 END AS renta_piloto
      FROM {_orders(d, 10)} GROUP BY client, mi"""
    out["limit_campaign_stage1"] = f"SELECT c_custkey AS rut FROM {d.table('customer')} WHERE c_mktsegment = 'BUILDING'"
    out["limit_campaign_stage2"] = f"""SELECT c_custkey AS rut FROM {d.table('customer')}
      WHERE c_mktsegment = 'MACHINERY' OR (c_mktsegment = 'BUILDING' AND c_acctbal > 5000)"""
    # the cohort study reads every month of the orders, unfolded
    out["cohort_month"] = f"""SELECT last_day(CAST(o_orderdate AS DATE)) AS fechacarga, {text('o_custkey')} AS contrato, o_custkey AS idcliente,
        {whole('max(o_totalprice)')} AS fcupo, sum({whole('l_extendedprice')}) AS fsaldeud,
        CAST(max(abs({d.days_between('l_shipdate', 'o_orderdate')}) % 120) AS BIGINT) AS moraac
      FROM {d.table('lineitem')} JOIN {d.table('orders')} ON l_orderkey = o_orderkey
      GROUP BY last_day(CAST(o_orderdate AS DATE)), o_custkey"""
    return out


SPARK_SOURCES = sources(SPARK)
DUCK_SOURCES = sources(DUCK)


LINES = 250_000  # order lines that a task gets, on average
# tables stored in buckets by client, and what names the client in them
BY_CLIENT = {"lines": "client", "orders_by_client": "o_custkey"}
# their times, of which every input reads the day alone
DAYS = {"lines": ["o_orderdate", "l_shipdate"], "orders_by_client": ["o_orderdate"]}


class Inputs:
    """The plans' inputs by name, each derived once.

    The cohort snapshots are read three times and stored; jobs that read many inputs also
    store the order lines and the orders all of them are derived from, in buckets by client,
    so that none of the groupings by client and month shuffles anything. There are as many
    buckets as shuffle partitions, and more if a task would get more than ``LINES`` lines.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: Sequence[str] = ("cohort_month",)):
        self.spark, self.sf_dir, self.stored = spark, sf_dir, stored
        self._known: dict[str, DataFrame] = {}

    @cached_property
    def buckets(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self("lineitem").count() // LINES))

    def _source(self, name: str, of: str) -> DataFrame:
        """What stands for a table in the SQL of ``of``: orders by client where the order lines are stored so."""
        if name == "orders" and of != "lines" and "lines" in self.stored and "o_custkey AS client" in SPARK_SOURCES[of]:
            return self("orders_by_client")
        if of == "lines" and self.buckets > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return self(name).repartition(self.buckets, {"lineitem": "l_orderkey", "orders": "o_orderkey"}[name])
        return self(name)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in TABLES:
                df = read(self.spark, self.sf_dir, name)
            elif name == "orders_by_client":
                df = self("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
            else:
                sql = SPARK_SOURCES[name]
                used = [t for t in [*TABLES, "lines"] if "{" + t + "}" in sql]
                df = self.spark.sql(sql, **{t: self._source(t, name) for t in used})
            if name in BY_CLIENT:
                # a time's day needs the session's zone: found once, and not in every grouping of the lines
                df = df.withColumns({c: F.to_date(c) for c in DAYS[name]})
                if "lines" in self.stored:
                    df = store_bucketed(df, name, BY_CLIENT[name], self.buckets)
                else:
                    df = df.repartition(self.buckets, BY_CLIENT[name])  # the provided file is a single split
            elif name in self.stored:
                df = store(df, name)
            self._known[name] = df
        return self._known[name]
