"""The inputs of the two jobs: fixed names and types of the columns the plans read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.sources.io import read

# Input layouts. Dates written as text and numbers written as text stay text.
INPUTS = {
    "client_id_map": "id_cliente string, id_corporativo string",
    "client_master": "idcliente string, idcorporativo string",
    "fraud_clients_a": "rut bigint, fecha_fraude date",
    "fraud_clients_b": "id_cliente bigint, fecha_venta date",
    "fin_transactions": "id_trx string, cod_contraparte string, fecha_informacion timestamp_ntz",
    "fraud_transactions": "id_trx string",
    "fraud_contracts": "contrato_final string",
    "account_month_old": (
        "fecha_foto date, contrato string, id_cliente bigint, centalta string, f_cupo double, coacti string, "
        "id_dia_aper string, id_dia_nac string, f_saldeud double, f_salde_su double, f_ava_ocu double, f_saldo double, "
        "mora_ac bigint, id_situ bigint, id_dia_reneg string, id_dia_maxultmov string, id_dia_cast string"
    ),
    "account_month": (
        "fechacarga date, contrato string, contratoalterno string, idcliente bigint, centalta string, fcupo double, "
        "coacti string, iddiaaper date, iddianac date, fsaldeud double, fsaldesu double, favaocu double, fsaldo double, "
        "moraac bigint, idsitu bigint, iddiareneg date, iddiamaxultmov date, iddiacast date"
    ),
    "contract_blocks": "contratoalterno string, descripcionbloqueo string, fechacarga date",
    "card_events": "contrato string, fechaoperacion date, tipofac bigint, destipfac string",
    "income_logic": "fecha_foto date, id_cliente bigint, renta_final double, tipo_renta_final string, renta_compras double",
    "bureau_month": "fecha_foto date, id_cliente bigint, linea_disp double, dconsumo double, dcomercial double, dhipotecar double",
    "preapproval_scores": "fecha_foto date, id_cliente bigint, segmento string, prob_preaprobados double",
    "preapproval_scores_restated": "fecha_foto date, id_cliente bigint, prob double",
    "mini_policy": (
        "fechafoto date, idcliente bigint, cumpleminipoliticabanco int, cumpleminipoliticatarjeta int, "
        "cumpleminipoliticacomercial int, cumpleminipoliticaburo int"
    ),
    "vehicles": "num_rut string, upload_dt date, vr_appraised_amt string, vr_type string, vr_year string",
    "real_estate_month": "id_cliente bigint, fecha_foto date, avaluo_total string",
    "houses": "nhr_owner_rut_id string, upload_dt date, nhr_prop_val_amt string",
    "preapproved_base": "idcliente bigint, fechafoto date, marcapreaprobadosbase int",
    "bureau_person": "idcliente string, fechanacimiento date, nacionalidad string, fechadefuncion date, fechacarga date",
    "application_log": (
        "dregistro string, idcliente bigint, nsolic string, niacpreaprobado string, aiafpreaprobado string, "
        "aaevaleafnodename string, arsltdpolcategoria string, niasosolicsucapert string, aiprevmfirmaautoprev string, "
        "diaccocfecrenta string, ctiposolic string, niaprenta string, rentpromprev double, antprevision bigint, "
        "numcotival bigint, aexctacastigada string, niapavaluopropiedad string, niaptasacionvehiculo string, "
        "niapaniovehiculo string, iantecedentesdelasolicitudai string, anacionalidad string, fechacarga date, norigen int"
    ),
    "retail_spend_s": "fecha_foto date, id_cliente bigint, monto_s_12m double",
    "retail_spend_f": "fecha_foto date, id_cliente bigint, monto_f_12m double",
    "retail_spend_t": "fecha_foto date, id_cliente bigint, monto_t_12m double",
    "provision_pd": "fechacarga date, ctacontrato string, pdfinal double",
    "income_pilot": "fecha_foto date, id_cliente bigint, renta_modelo double, flag_con_info int, renta_piloto double",
    "limit_campaign_stage1": "rut bigint",
    "limit_campaign_stage2": "rut bigint",
}


def conform(df: DataFrame, name: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """The declared columns of an input, in the declared types; others are left out.

    ``columns`` maps a declared name to the name it has in ``df`` where they differ.
    """
    found = columns or {}
    declared = StructType.fromDDL(INPUTS[name])
    return df.select(*[F.col(found.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in declared])


def read_input(spark: SparkSession, base: str, name: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    return conform(read(spark, base, name), name, columns)
