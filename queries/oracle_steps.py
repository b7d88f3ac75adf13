"""Checking SQL of the plan steps, written for the checking engine and not from the Spark plans.

Where a plan rewrites an expensive form (windows for range self-joins, one join for four
horizons, marks for anti joins), the SQL here keeps the direct form.
"""

from __future__ import annotations

import re

from queries.checking_values import BANDS, KEYS, MONTH_LABELS, PREAPPROVED, SPONTANEOUS, SUMMED, SUMS
from queries.mapping import DUCK_SOURCES


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def band_lines(name: str) -> list[tuple[str, float | None, str]]:
    """(operator or NULL or ELSE, bound, label) of a band, in order."""
    out = []
    for line in BANDS[name].strip().splitlines():
        head, _, rest = line.strip().partition(" ")
        bound, _, label = ("", "", rest) if head in ("NULL", "ELSE") else rest.partition(" ")
        out.append((head, float(bound) if bound else None, label))
    return out


def ladder_sql(name: str, x: str) -> str:
    arms, last = [], ""
    for head, bound, label in band_lines(name):
        if head == "ELSE":
            last = f" ELSE {quoted(label)}"
        else:
            arms.append(f"WHEN {x} {'IS NULL' if head == 'NULL' else f'{head} CAST({bound} AS DOUBLE)'} THEN {quoted(label)}")
    return "CASE " + " ".join(arms) + last + " END"


def later(d: str, n: int) -> str:
    return f"CAST({d} + INTERVAL {n} MONTH AS DATE)"


def month_of(d: str) -> str:
    return f"CAST(date_trunc('month', {d}) AS DATE)"


STEPS: dict[str, str] = {}

# ---- limit-increase cohort -------------------------------------------------------------
STEPS["d_campaign_clients"] = """
SELECT DISTINCT rut AS IdCliente, 1 AS Aumento_Campania
FROM (SELECT rut FROM limit_campaign_stage1 UNION ALL SELECT rut FROM limit_campaign_stage2)"""
STEPS["d_month_panel"] = f"SELECT *, {month_of('fechacarga')} AS FechaFoto FROM cohort_month WHERE fechacarga = last_day(fechacarga)"
STEPS["d_limit_changes"] = """
SELECT FechaFoto, Contrato, IdCliente, FCupoActual, FCupoAnterior,
  CASE sign(FCupoActual - FCupoAnterior) WHEN 1 THEN 'Aumento' WHEN -1 THEN 'Disminuyo' ELSE '' END AS CambioCupo
FROM (SELECT FechaFoto, contrato AS Contrato, idcliente AS IdCliente, fcupo AS FCupoActual,
        lag(fcupo) OVER (PARTITION BY contrato ORDER BY FechaFoto) AS FCupoAnterior FROM d_month_panel)"""
STEPS["d_first_increase"] = """
SELECT arg_min(FechaFoto, FechaFoto) AS FechaFoto, IdCliente, arg_min(Contrato, FechaFoto) AS Contrato, 1 AS Aumento,
  arg_min(FCupoAnterior, FechaFoto) AS FCupoAnterior, arg_min(FCupoActual, FechaFoto) AS FCupoActual
FROM d_limit_changes WHERE CambioCupo = 'Aumento' GROUP BY IdCliente"""
STEPS["d_increase_follow_up"] = """
SELECT i.FechaFoto AS FechaAumento, p.FechaFoto, i.IdCliente, i.Contrato, i.FCupoAnterior, i.FCupoActual,
  i.FCupoActual - i.FCupoAnterior AS MontoAumento,
  CASE WHEN i.FCupoAnterior <> 0 THEN (i.FCupoActual - i.FCupoAnterior) / i.FCupoAnterior * 100 END AS Porc_Aumento,
  CASE WHEN c.IdCliente IS NULL THEN 0 ELSE 1 END AS Aumento_Campania,
  CASE WHEN k = -1 THEN 'Mmenos1' WHEN k <= 10 THEN 'M' || k ELSE 'M_Otros' END AS Mes,
  CASE WHEN k <= 10 THEN p.fsaldeud ELSE 0 END AS DeudaL1,
  CASE WHEN k <= 10 THEN CASE WHEN p.fcupo <> 0 THEN p.fsaldeud / p.fcupo END ELSE 0 END AS Utilizacion,
  CASE WHEN k <= 10 AND p.moraac >= 30 THEN p.fsaldeud ELSE 0 END AS DeudaMorosa30,
  CASE WHEN k <= 10 THEN p.fsaldeud ELSE 0 END AS DeudaTotalL1
FROM d_first_increase i
LEFT JOIN (SELECT *, 12 * year(FechaFoto) + month(FechaFoto) AS ix FROM d_month_panel) p
  ON p.contrato = i.Contrato AND p.ix >= 12 * year(i.FechaFoto) + month(i.FechaFoto) - 1
LEFT JOIN d_campaign_clients c ON c.IdCliente = i.IdCliente
CROSS JOIN LATERAL (SELECT date_diff('month', i.FechaFoto, p.FechaFoto) AS k) z"""
_wide = []
for _m in MONTH_LABELS:
    _wide.append(f"count(IdCliente) FILTER (Mes = '{_m}') AS N_{_m}")
    _wide += [f"sum({_c}) FILTER (Mes = '{_m}') AS {_c}_{_m}" for _c in SUMMED]
STEPS["d_increase_pivot"] = (
    "SELECT FechaAumento, Aumento_Campania, " + ", ".join(_wide)
    + " FROM d_increase_follow_up GROUP BY FechaAumento, Aumento_Campania"
)
_report = ["N_Mmenos1 AS N", "FCupoAnterior_Mmenos1 AS CupoAnterior", "FCupoActual_Mmenos1 AS CupoActual",
           "MontoAumento_Mmenos1 AS MontoAumento", "Porc_Aumento_Mmenos1 AS Porc_Aumento"]
_report += [f"DeudaL1_{_m}" for _m in MONTH_LABELS] + [f"Utilizacion_{_m}" for _m in MONTH_LABELS]
_report += [f"{_c}_M{_k}" for _k in range(1, 7) for _c in ("DeudaMorosa30", "DeudaTotalL1")]
for _flag, _name in ((0, "q_limit_cohort_report"), (1, "q_limit_cohort_report_campaign")):
    STEPS[_name] = (
        "SELECT FechaAumento, Aumento_Campania, " + ", ".join(_report)
        + f" FROM d_increase_pivot WHERE Aumento_Campania = {_flag} ORDER BY FechaAumento"
    )

# ---- accounts --------------------------------------------------------------------------
STEPS["d_client_ids"] = "SELECT CAST(id_cliente AS BIGINT) AS IdCliente, id_corporativo AS IdCorporativo FROM client_id_map"
STEPS["d_fraud_clients"] = """
SELECT IdCliente, max(d) AS FechaFraude, 1 AS MarcaFraude FROM (
  SELECT rut AS IdCliente, fecha_fraude AS d FROM fraud_clients_a
  UNION ALL SELECT id_cliente, fecha_venta FROM fraud_clients_b
  UNION ALL SELECT i.IdCliente, CAST(t.fecha_informacion AS DATE) FROM fin_transactions t
    JOIN fraud_transactions f USING (id_trx) LEFT JOIN d_client_ids i ON i.IdCorporativo = t.cod_contraparte)
GROUP BY IdCliente"""
STEPS["d_fraud_contracts"] = "SELECT '00' || contrato_final AS Contrato, 1 AS MarcaFraude2 FROM fraud_contracts"
_panel = [
    ("FechaFoto", "fecha_foto", "date_trunc('month', fechacarga)", "DATE"),
    ("Contrato", "contrato", "contrato", "VARCHAR"), ("ContratoAlterno", "''", "contratoalterno", "VARCHAR"),
    ("IdCliente", "id_cliente", "idcliente", "BIGINT"), ("SucursalApertura", "centalta", "centalta", "VARCHAR"),
    ("Cupo", "f_cupo", "fcupo", "DOUBLE"), ("CodigoActividad", "coacti", "coacti", "VARCHAR"),
    ("FechaApertura", "try_cast(id_dia_aper AS DATE)", "iddiaaper", "DATE"),
    ("FechaNacimiento", "try_cast(id_dia_nac AS DATE)", "iddianac", "DATE"),
    ("DeudaL1", "f_saldeud", "fsaldeud", "DOUBLE"), ("DeudaL2", "f_salde_su", "fsaldesu", "DOUBLE"),
    ("DeudaAvance", "f_ava_ocu", "favaocu", "DOUBLE"), ("DeudaTotal", "f_saldo", "fsaldo", "DOUBLE"),
    ("DiasMora", "mora_ac", "moraac", "BIGINT"), ("IdSitu", "id_situ", "idsitu", "BIGINT"),
    ("FechaRenegociacion", "try_cast(id_dia_reneg AS DATE)", "iddiareneg", "DATE"),
    ("FechaUltimoMovimiento", "try_cast(id_dia_maxultmov AS DATE)", "iddiamaxultmov", "DATE"),
    ("FechaCastigo", "id_dia_cast", "iddiacast", "DATE"),
]
STEPS["d_panel_rows"] = (
    "SELECT " + ", ".join(f"CAST({o} AS {t}) AS {n}" for n, o, _, t in _panel)
    + " FROM account_month_old WHERE fecha_foto BETWEEN DATE '2021-01-01' AND DATE '2022-04-01' UNION SELECT "
    + ", ".join(f"CAST({o} AS {t})" for _, _, o, t in _panel)
    + """ FROM account_month WHERE fechacarga = last_day(fechacarga) AND fechacarga BETWEEN DATE '2022-05-31' AND DATE '2023-04-30'
    AND NOT (date_trunc('month', iddiaaper) = DATE '2022-09-01' AND iddianac = DATE '1990-05-05' AND fcupo = 50000)"""
)
STEPS["d_account_panel"] = """
SELECT *, lag(IdSitu) OVER (PARTITION BY Contrato ORDER BY FechaFoto) AS IdSitu_Mmenos1 FROM d_panel_rows"""
STEPS["d_permanent_blocks"] = f"""
SELECT *, {month_of('fechacarga')} AS FechaFoto FROM contract_blocks
WHERE descripcionbloqueo <> 'Temporal' AND descripcionbloqueo <> 'Fraude'
  AND fechacarga >= DATE '2022-01-01' AND month(fechacarga + 1) <> month(fechacarga)"""
STEPS["d_openings"] = """
SELECT p.FechaFoto, p.IdCliente, p.Contrato, p.ContratoAlterno, SucursalApertura, Cupo, DeudaTotal, DeudaL1, DeudaL2,
  IdSitu, DiasMora, FechaApertura, FechaNacimiento, date_diff('month', FechaNacimiento, p.FechaFoto) AS EdadMeses,
  FechaRenegociacion, FechaUltimoMovimiento, CodigoActividad, b.descripcionbloqueo AS DescripcionBloqueo,
  coalesce(e.label, 'Otros') AS TipoEmpleo, CAST(coalesce(DiasMora > 0, false) AS INT) AS TieneMora,
  CASE WHEN DeudaL2 > 0 THEN 'Super Avance' WHEN DeudaAvance > 0 THEN 'Avance' WHEN DeudaL1 > 0 THEN 'TC' ELSE 'Sin deuda' END AS SegmentoUso,
  CAST(coalesce(SucursalApertura = '9999', false) AS INT) AS AperturaWeb, f.FechaFraude,
  CAST(f.IdCliente IS NOT NULL AS INT) AS MarcaFraude, CAST(coalesce(opened, false) AS INT) AS Apertura,
  CASE WHEN NOT coalesce(back, false) THEN 'Originacion'
       WHEN p.FechaFoto < DATE '2022-08-01' OR b.descripcionbloqueo IS NOT NULL THEN 'Reapertura' ELSE 'Desbloqueo' END AS Reapertura
FROM (SELECT *, date_trunc('month', FechaApertura) = FechaFoto AS opened, IdSitu = 1 AND IdSitu_Mmenos1 = 2 AS back FROM d_account_panel) p
LEFT JOIN d_fraud_clients f ON f.IdCliente = p.IdCliente
LEFT JOIN d_permanent_blocks b ON b.contratoalterno = p.ContratoAlterno AND date_diff('month', b.FechaFoto, p.FechaFoto) = 1
LEFT JOIN (VALUES (1,'Independiente'),(3,'Independiente'),(5,'Independiente'),(8,'Independiente'),(15,'Independiente'),
  (2,'Dependiente'),(4,'Dependiente'),(6,'Dependiente'),(7,'Dependiente'),(9,'Dependiente'),(10,'Dependiente'),(14,'Dependiente'),
  (16,'Dependiente'),(11,'Jubilado'),(12,'Dueña de Casa'),(13,'Estudiante')) e(code, label) ON e.code = try_cast(CodigoActividad AS BIGINT)
WHERE opened OR back"""
STEPS["d_renegotiated"] = """
SELECT DISTINCT contrato AS Contrato, 1 AS Renegociacion FROM (
  SELECT e.contrato, e.tipofac, row_number() OVER (PARTITION BY e.contrato ORDER BY e.fechaoperacion, e.tipofac) AS n
  FROM card_events e JOIN d_openings s ON s.ContratoAlterno = e.contrato
  WHERE e.fechaoperacion > DATE '2021-01-01' AND e.fechaoperacion <= s.FechaApertura + INTERVAL 1 MONTH)
WHERE n <= 10 AND tipofac = 96022"""

# ---- attributes ------------------------------------------------------------------------
STEPS["d_estimated_income"] = f"""
SELECT {later('fecha_foto', 2)} AS FechaFoto, id_cliente AS IdCliente, renta_final AS RentaEstimada,
  tipo_renta_final AS TipoRentaEstimada, renta_compras AS RentaCompras, CAST(coalesce(renta_compras, 0) > 0 AS INT) AS TenenciaRetail
FROM income_logic WHERE fecha_foto >= DATE '2020-12-01'"""
_measures = {"LineaDisponible": "linea_disp", "DeudaConsumo": "dconsumo", "DeudaComercial": "dcomercial", "DeudaHipotecario": "dhipotecar"}
STEPS["d_bureau_windows"] = (
    f"SELECT {later('b.fecha_foto', 2)} AS FechaFoto, b.id_cliente AS IdCliente, "
    + ", ".join(f"any_value(1000 * b.{c}) AS {m}" for m, c in _measures.items()) + ", "
    + ", ".join(f"sum(1000 * h.{c}) FILTER (gap <= 2) AS {m}SumU03M" for m, c in _measures.items()) + ", "
    + ", ".join(f"avg(1000 * h.{c}) FILTER (gap <= 2) AS {m}PromU03M" for m, c in _measures.items())
    + """, count(*) FILTER (gap <= 2) AS MesesConBuro,
  count(*) FILTER (h.linea_disp + h.dconsumo + h.dcomercial + h.dhipotecar > 0) AS RecuentoBancarizadoU06M
FROM bureau_month b JOIN bureau_month h ON h.id_cliente = b.id_cliente AND h.fecha_foto BETWEEN b.fecha_foto - INTERVAL 5 MONTH AND b.fecha_foto
CROSS JOIN LATERAL (SELECT date_diff('month', h.fecha_foto, b.fecha_foto) AS gap) z
WHERE b.fecha_foto >= DATE '2020-11-01' AND h.fecha_foto >= DATE '2020-06-01' GROUP BY b.fecha_foto, b.id_cliente"""
)
_outcomes = []
for _h, _days in ((2, [30]), (3, [30]), (6, [30, 60]), (12, [30, 60, 90])):
    for _out, _in in (
        [("DeudaTotal", "total"), ("DeudaL1", "l1"), ("MesesConVintage", "months"), ("MarcaDeudaSA", "l2"), ("RiesgoVivo", "alive")]
        + [(f"MarcaMora{_d}", f"dpd{_d}") for _d in _days]
    ):
        _outcomes.append(f"max({_in}) FILTER (h = {_h}) AS {_out}Mes{_h:02d}")
STEPS["d_vintage_outcomes"] = (
    "SELECT FechaFoto, IdCliente, Contrato, " + ", ".join(_outcomes)
    + """ FROM (SELECT s.FechaFoto, s.IdCliente, s.Contrato, h,
      max(CASE WHEN gap = h AND p.DeudaTotal > 0 THEN p.DeudaTotal ELSE 0 END) AS total,
      max(CASE WHEN gap = h AND p.DeudaL1 > 0 THEN p.DeudaL1 ELSE 0 END) AS l1,
      count(DISTINCT p.FechaFoto) AS months, CAST(coalesce(bool_or(p.DeudaL2 > 0), false) AS INT) AS l2,
      CAST(coalesce(bool_or(coalesce(p.FechaUltimoMovimiento > DATE '1800-01-01', false) OR coalesce(p.DeudaTotal >= 10000, false)), false) AS INT) AS alive,
      CAST(coalesce(bool_or(p.DiasMora >= 30), false) AS INT) AS dpd30, CAST(coalesce(bool_or(p.DiasMora >= 60), false) AS INT) AS dpd60,
      CAST(coalesce(bool_or(p.DiasMora >= 90), false) AS INT) AS dpd90
    FROM (SELECT DISTINCT FechaFoto, IdCliente, Contrato FROM d_openings) s CROSS JOIN (VALUES (2), (3), (6), (12)) v(h)
    LEFT JOIN d_panel_rows p ON p.Contrato = s.Contrato AND p.FechaFoto >= s.FechaFoto AND p.FechaFoto <= s.FechaFoto + to_months(CAST(h AS INTEGER))
    CROSS JOIN LATERAL (SELECT date_diff('month', s.FechaFoto, p.FechaFoto) AS gap) z
    GROUP BY s.FechaFoto, s.IdCliente, s.Contrato, h) GROUP BY FechaFoto, IdCliente, Contrato"""
)
STEPS["d_preapproval_grade"] = f"""
SELECT {later('fecha_foto', 2)} AS FechaFoto, fecha_foto AS FechaCortePreaprobados, id_cliente AS IdCliente,
  segmento AS ClasificacionPreaprobados, prob_preaprobados AS ProbPreaprobados,
  {ladder_sql('PROBABILITY', 'prob_preaprobados')} AS TramoProbabilidadPreap,
  CASE WHEN fecha_foto < DATE '2022-08-01' THEN {ladder_sql('GRADE_BEFORE', 'prob_preaprobados')}
       ELSE {ladder_sql('GRADE', 'prob_preaprobados')} END AS SegmentoPreaprobados
FROM preapproval_scores WHERE fecha_foto >= DATE '2020-11-01'"""
STEPS["d_preapproval_grade_restated"] = f"""
SELECT {later('fecha_foto', 2)} AS FechaFoto, id_cliente AS IdCliente, prob AS PROB_REEST,
  {ladder_sql('GRADE', 'prob')} AS SegmentoPreaprobados_Reest
FROM preapproval_scores_restated WHERE fecha_foto >= DATE '2021-06-01'"""
_flags = ["Banco", "Tarjeta", "Comercial", "Buro"]
STEPS["d_mini_policy"] = (
    f"SELECT {later('fechafoto', 1)} AS FechaFoto, idcliente AS IdCliente, "
    + ", ".join(f"cumpleminipolitica{f.lower()} AS CumpleMinipolitica{f}" for f in _flags) + ", "
    + " * ".join(f"cumpleminipolitica{f.lower()}" for f in _flags)
    + " AS CumpleMinipolitica FROM mini_policy WHERE fechafoto >= DATE '2020-12-01'"
)
_types = (
    "'AUTOMOVIL','STATION WAGON','CAMIONETA','FURGON','CAMION','MAQUINA INDUSTRIAL','JEEP','BUS','MINIBUS','TRACTOR',"
    "'TRACTOCAMION','AMBULANCIA','MAQUINA AGRICOLA','CARROBOMBA','MICROBUS','OMNIBUS','TROLEBUS'"
)
STEPS["d_vehicle_totals"] = f"""
SELECT CAST(m.idcliente AS BIGINT) AS IdCliente, {month_of('upload_dt')} AS FechaFoto,
  sum(coalesce(try_cast(trim(vr_appraised_amt) AS DOUBLE), 0)) AS TasacionTotal
FROM vehicles v LEFT JOIN client_master m ON m.idcorporativo = v.num_rut
WHERE upload_dt < DATE '2022-01-01' AND vr_type IN ({_types})
  AND year(upload_dt) - greatest(coalesce(CAST(vr_year AS INT), 0), 1900) <= 15 GROUP BY 1, 2"""
STEPS["d_property_totals"] = f"""
SELECT id_cliente AS IdCliente, {month_of('fecha_foto')} AS FechaFoto, CAST(sum(CAST(avaluo_total AS BIGINT)) AS BIGINT) AS AvaluoTotal
FROM real_estate_month WHERE fecha_foto >= DATE '2020-06-01' AND fecha_foto < DATE '2022-01-01' GROUP BY 1, 2
UNION ALL
SELECT CAST(m.idcliente AS BIGINT), {month_of('upload_dt')}, CAST(sum(CAST(nhr_prop_val_amt AS BIGINT)) AS BIGINT)
FROM houses h LEFT JOIN client_master m ON m.idcorporativo = h.nhr_owner_rut_id WHERE upload_dt < DATE '2022-01-01' GROUP BY 1, 2"""
for _name, _value in (("vehicle", "TasacionTotal"), ("property", "AvaluoTotal")):
    STEPS[f"d_{_name}_wealth"] = f"""
SELECT FechaFoto, IdCliente, {_value} FROM (
  SELECT s.FechaFoto, s.IdCliente, w.{_value},
    row_number() OVER (PARTITION BY s.FechaFoto, s.IdCliente ORDER BY w.FechaFoto DESC NULLS LAST, w.{_value} DESC NULLS LAST) AS n
  FROM (SELECT DISTINCT FechaFoto, IdCliente FROM d_openings) s LEFT JOIN d_{_name}_totals w
    ON w.IdCliente = s.IdCliente AND date_diff('month', w.FechaFoto, s.FechaFoto) BETWEEN 0 AND 12)
WHERE n = 1"""
STEPS["d_preapproved_base"] = """
SELECT idcliente AS IdCliente, fechafoto AS FechaFoto, marcapreaprobadosbase AS MarcaPreaprobadosBase FROM preapproved_base"""
STEPS["d_person_latest"] = """
SELECT IdCliente, FechaNacimientoBuro, NacionalidadBuro, FechaDefuncion FROM (
  SELECT i.IdCliente, fechanacimiento AS FechaNacimientoBuro, CAST(if(nacionalidad = 'C', 152, 999) AS BIGINT) AS NacionalidadBuro,
    fechadefuncion AS FechaDefuncion, row_number() OVER (PARTITION BY i.IdCliente ORDER BY fechacarga DESC) AS n
  FROM bureau_person p LEFT JOIN d_client_ids i ON i.IdCorporativo = p.idcliente WHERE fechacarga >= DATE '2021-01-01')
WHERE n = 1"""
STEPS["d_applications"] = f"""
SELECT {month_of('CAST(dregistro AS TIMESTAMP)')} AS FechaFoto, CAST(CAST(dregistro AS TIMESTAMP) AS DATE) AS FechaSolicitud,
  dregistro AS DRegistro, idcliente AS IdCliente, nsolic AS NumeroSolicitud, niacpreaprobado AS CodigoPreaprobado,
  CAST(coalesce(aiafpreaprobado, '0') AS BIGINT) AS MarcaPreaprobadoMotor, aaevaleafnodename AS NodoEvaluacion,
  arsltdpolcategoria AS CategoriaPolitica, if(niasosolicsucapert = '9999', 'Web', 'Presencial') AS CanalMotor,
  aiprevmfirmaautoprev AS AutorizaPrevision, diaccocfecrenta AS FechaRentaSolicitud,
  CAST(if(ctiposolic = 'EVA', greatest(coalesce(CAST(niaprenta AS BIGINT), 0), 0), 0) AS BIGINT) AS RentaSolicitud, rentpromprev AS RentaPrevisionU03M,
  if(antprevision <= 45 AND rentpromprev > 0, rentpromprev, 0) AS RentaPrevisionValidaU03M, antprevision AS AntiguedadPrevision,
  numcotival AS NumeroCotizacionesU03M, aexctacastigada AS MarcaExCastigada, CAST(niapavaluopropiedad AS BIGINT) AS AvaluoPropiedad,
  CAST(niaptasacionvehiculo AS BIGINT) AS TasacionVehiculo, CAST(niapaniovehiculo AS BIGINT) AS AgnoVehiculo,
  iantecedentesdelasolicitudai AS ClasificacionApertura, CAST(replace(anacionalidad, 'CL', '152') AS BIGINT) AS NacionalidadMotor
FROM application_log WHERE fechacarga >= DATE '2020-09-01' AND norigen = 2"""
STEPS["d_last_application"] = """
SELECT * EXCLUDE (n) FROM (
  SELECT a.*, s.Contrato, row_number() OVER (PARTITION BY s.Contrato, s.FechaFoto
      ORDER BY a.DRegistro DESC NULLS LAST, a.NumeroSolicitud DESC NULLS LAST) AS n
  FROM d_openings s LEFT JOIN d_applications a ON a.IdCliente = s.IdCliente AND a.FechaFoto <= s.FechaFoto)
WHERE n = 1"""
_spend = [f"coalesce({x}.monto_{x}_12m, 0)" for x in "sft"]
STEPS["d_retail_spend"] = (
    "SELECT b.FechaFoto, b.IdCliente, "
    + ", ".join(f"{e} AS Compras{x.upper()}U12M" for x, e in zip("sft", _spend)) + ", "
    + ", ".join(f"CAST({e} > 0 AS INT) AS Tenencia{x.upper()}U12M" for x, e in zip("sft", _spend))
    + " FROM (SELECT DISTINCT FechaFoto, IdCliente FROM d_openings) b "
    + " ".join(
        f"LEFT JOIN retail_spend_{x} {x} ON {x}.id_cliente = b.IdCliente AND {x}.fecha_foto >= DATE '2020-12-01'"
        f" AND date_diff('month', {x}.fecha_foto, b.FechaFoto) = 1" for x in "sft"
    )
)
STEPS["d_provision_pd"] = f"""
SELECT fechacarga AS FechaFoto, ctacontrato AS Contrato, pdfinal AS Pd_Provisiones,
  {ladder_sql('PROBABILITY', 'pdfinal')} AS TramoPdProvisiones FROM provision_pd WHERE fechacarga >= DATE '2020-12-01'"""
STEPS["d_pilot_income"] = f"""
SELECT {later('fecha_foto', 2)} AS FechaFoto, id_cliente AS IdCliente, renta_modelo AS Renta, flag_con_info AS Flag,
  renta_piloto AS RentaPiloto FROM income_pilot WHERE fecha_foto >= DATE '2022-07-01'"""

# ---- the tracking table ----------------------------------------------------------------
_joined = """d_openings s
  LEFT JOIN d_estimated_income i ON i.IdCliente = s.IdCliente AND i.FechaFoto = s.FechaFoto
  LEFT JOIN d_bureau_windows b ON b.IdCliente = s.IdCliente AND b.FechaFoto = s.FechaFoto
  LEFT JOIN d_vintage_outcomes v ON v.Contrato = s.Contrato AND v.FechaFoto = s.FechaFoto
  LEFT JOIN d_last_application a ON a.Contrato = s.Contrato AND a.FechaFoto = s.FechaFoto
  LEFT JOIN d_preapproval_grade g ON g.IdCliente = s.IdCliente AND g.FechaFoto = s.FechaFoto
  LEFT JOIN d_mini_policy mp ON mp.IdCliente = s.IdCliente AND mp.FechaFoto = s.FechaFoto
  LEFT JOIN d_vehicle_wealth vw ON vw.IdCliente = s.IdCliente AND vw.FechaFoto = s.FechaFoto
  LEFT JOIN d_property_wealth pw ON pw.IdCliente = s.IdCliente AND pw.FechaFoto = s.FechaFoto
  LEFT JOIN d_preapproved_base pb ON pb.IdCliente = s.IdCliente AND pb.FechaFoto = s.FechaFoto
  LEFT JOIN d_person_latest pl ON pl.IdCliente = s.IdCliente
  LEFT JOIN d_retail_spend r ON r.IdCliente = s.IdCliente AND r.FechaFoto = s.FechaFoto
  LEFT JOIN d_provision_pd pd ON pd.Contrato = s.Contrato AND pd.FechaFoto = s.FechaFoto
  LEFT JOIN d_fraud_contracts fc ON fc.Contrato = s.Contrato
  LEFT JOIN d_preapproval_grade_restated gr ON gr.IdCliente = s.IdCliente AND gr.FechaFoto = s.FechaFoto
  LEFT JOIN d_pilot_income pi ON pi.IdCliente = s.IdCliente AND pi.FechaFoto = s.FechaFoto
  LEFT JOIN d_renegotiated rn ON rn.Contrato = s.Contrato"""
_late = []
for _d, _h in ((30, "02"), (30, "03"), (30, "06"), (60, "06"), (90, "12")):
    _late.append(f"DeudaTotalMes{_h} * coalesce(MarcaMora{_d}Mes{_h}, 0) AS DeudaMorosa{_d}Mes{_h}")
    _late.append(f"coalesce(MarcaMora{_d}Mes{_h}, 0) AS Casos{_d}Mes{_h}")
_burden = "coalesce(DeudaConsumo, 0) * 0.035::DOUBLE + coalesce(DeudaHipotecario, 0) / 240 + coalesce(DeudaL1, 0) / 6 + coalesce(DeudaL2, 0) / 24"
STEPS["d_joined"] = f"""
SELECT s.*, i.* EXCLUDE (FechaFoto, IdCliente), b.* EXCLUDE (FechaFoto, IdCliente), v.* EXCLUDE (FechaFoto, IdCliente, Contrato),
  a.* EXCLUDE (FechaFoto, IdCliente, Contrato), g.* EXCLUDE (FechaFoto, IdCliente, SegmentoPreaprobados, ProbPreaprobados),
  mp.* EXCLUDE (FechaFoto, IdCliente), vw.TasacionTotal, pw.AvaluoTotal, pb.MarcaPreaprobadosBase, pl.* EXCLUDE (IdCliente),
  r.* EXCLUDE (FechaFoto, IdCliente), pd.Pd_Provisiones, pd.TramoPdProvisiones, coalesce(pi.RentaPiloto, 0) AS RentaPiloto,
  coalesce(gr.PROB_REEST, g.ProbPreaprobados) AS PROB_REEST, coalesce(gr.SegmentoPreaprobados_Reest, g.SegmentoPreaprobados) AS SegmentoPreaprobados,
  coalesce(gr.PROB_REEST, g.ProbPreaprobados) AS ProbPreaprobados, g.SegmentoPreaprobados AS SegmentoPreaprobados_Antiguo,
  g.ProbPreaprobados AS ProbPreaprobados_Antiguo, a.IdCliente AS called, fc.MarcaFraude2 AS listed,
  date_diff('day', a.FechaSolicitud, s.FechaApertura) AS AntiguedadSolicitud,
  CASE WHEN a.FechaSolicitud IS NULL THEN 'source' WHEN date_diff('day', a.FechaSolicitud, s.FechaApertura) <= 60 THEN 'application'
       WHEN s.FechaApertura IS NULL THEN 'unknown' ELSE 'source' END AS origin
FROM {_joined} WHERE s.Reapertura <> 'Desbloqueo' AND rn.Contrato IS NULL"""
STEPS["d_enriched"] = f"""
SELECT * EXCLUDE (called, listed, origin, pat, retail_spend_sum),
  CAST(coalesce(AntiguedadSolicitud <= 60, false) AS INT) AS MarcaSolicitudMotorValida,
  CAST(greatest(coalesce(RentaSolicitud, 0), coalesce(RentaPrevisionValidaU03M, 0)) AS DOUBLE) AS RentaEvaluacion,
  CAST(coalesce(DeudaConsumo, 0) + coalesce(LineaDisponible, 0) + coalesce(DeudaComercial, 0) + coalesce(DeudaHipotecario, 0) > 0 AS INT) AS MarcaBancarizadoU01M,
  CAST(coalesce(RecuentoBancarizadoU06M, 0) >= 6 AS INT) AS MarcaBancarizadoU06M,
  CASE WHEN DeudaConsumoSumU03M IS NULL OR LineaDisponibleSumU03M + DeudaConsumoSumU03M = 0 THEN -1
       ELSE DeudaConsumoSumU03M / (LineaDisponibleSumU03M + DeudaConsumoSumU03M) END AS RatioDeudaLineaMasDeudaU03M,
  1 AS CasosTotal, {_burden} AS CargaFinanciera,
  CASE WHEN RentaEstimada > 0 THEN ({_burden}) / RentaEstimada ELSE -1 END AS DTI,
  CASE origin WHEN 'application' THEN coalesce(AvaluoPropiedad, 0) WHEN 'source' THEN coalesce(AvaluoTotal, 0) ELSE 0 END AS MontoPropiedad,
  CASE origin WHEN 'application' THEN coalesce(TasacionVehiculo, 0) WHEN 'source' THEN coalesce(TasacionTotal, 0) ELSE 0 END AS MontoVehiculos,
  pat AS MontoPatrimonio, CAST(pat > 0 AS INT) AS TenenciaPatrimonio,
  if(coalesce(CASE origin WHEN 'application' THEN NacionalidadMotor WHEN 'source' THEN NacionalidadBuro END = 152, false), 'Chileno', 'Extranjero') AS Nacionalidad,
  if(coalesce(CASE origin WHEN 'application' THEN MarcaPreaprobadoMotor WHEN 'source' THEN MarcaPreaprobadosBase END = 1, false), 'Preaprobado', 'Espontaneo') AS MarcaPreaprobado,
  CASE WHEN IdSitu = 2 THEN '03. Suspendido' WHEN IdSitu = 3 THEN '04. Castigado'
       WHEN (MarcaFraude = 1 OR listed = 1) AND date_diff('month', FechaFoto, FechaFraude) <= 12 THEN '05. Fraude'
       WHEN date_diff('month', FechaDefuncion, FechaFoto) >= 0 THEN '06. Fallecido' ELSE 'Otros' END AS SegmentoAplicaVintage,
  CAST(retail_spend_sum > 0 AS INT) AS TenenciaRetailML,
  CASE WHEN EdadMeses < 300 THEN 'Edad <25' WHEN RecuentoBancarizadoU06M >= 6 THEN 'Bancarizado U06M'
       WHEN retail_spend_sum > 0 THEN 'NB U06M con info' ELSE 'NB U06M sin info' END AS SegmentoPoliticas,
  if(called IS NULL, 'Sin llamada al motor', 'Con llamada al motor') AS LlamadaMotor,
  if(coalesce(date_diff('month', FechaDefuncion, FechaFoto) >= 0, false), 'Fallecido', 'No Fallecido') AS Fallecidos,
  {', '.join(_late)},
  row_number() OVER (PARTITION BY Contrato, FechaFoto ORDER BY FechaSolicitud DESC NULLS LAST, DescripcionBloqueo NULLS FIRST) AS Ranking
FROM (SELECT *, coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) AS retail_spend_sum,
  CASE origin WHEN 'application' THEN coalesce(AvaluoPropiedad, 0) + coalesce(TasacionVehiculo, 0)
              WHEN 'source' THEN coalesce(AvaluoTotal, 0) + coalesce(TasacionTotal, 0) ELSE 0 END AS pat FROM d_joined)"""

def waterfall_sql(rules: str) -> str:
    """The first code of the list of codes whose condition holds."""
    lines = [line.strip().split(" | ") for line in rules.strip().splitlines()]
    return f"coalesce({', '.join(f'CASE WHEN {condition} THEN {quoted(code)} END' for code, condition in lines)}, 'APROBADO FEBRERO23')"


def rollup_sql() -> str:
    """The policy month is the third word of the reason code (codes have no other layout)."""
    code = "if(MarcaPreaprobado = 'Espontaneo', CambiosEspontaneo, CambiosPreaprobadoSinT)"
    month = f"split_part({code}, ' ', 3)"
    since = (
        f"CASE {month} WHEN 'MAYO22' THEN DATE '2022-05-01' WHEN 'AGOSTO22' THEN DATE '2022-08-01' "
        "WHEN 'OCTUBRE22' THEN DATE '2022-10-01' WHEN 'NOVIEMBRE22' THEN DATE '2022-11-01' ELSE DATE '2023-02-01' END"
    )
    gap = f"if({month} = 'FEBRERO23' AND MarcaPreaprobado = 'Espontaneo' AND FechaFoto >= {since}, repeat(' ', 8), ' ')"
    return (
        f"CASE WHEN {code} LIKE 'APROBADO%' THEN 'APROBADO' "
        f"ELSE 'RECHAZADO' || {gap} || {month} || if(FechaFoto >= {since}, ' FECHAS', '') END"
    )


def cross_sql(banked: str) -> str:
    return (
        f"if({banked} = 1, 'B', 'NB') || CASE WHEN TenenciaPatrimonio + TenenciaRetailML = 0 THEN ' - SIN PAT - SIN RETAIL' "
        "ELSE if(TenenciaPatrimonio = 1, ' - CON PAT', '') || if(TenenciaRetailML = 1, ' - CON RETAIL', '') END"
    )


def channel_sql(flag: str, what: str) -> str:
    return f"if({flag} = 1, '{what}', 'No {what}') || if(AperturaWeb = 1, ' - Digital', ' - Presencial')"


STEPS["d_segmented"] = f"""
SELECT *, ProbPreaprobados AS ProbPreapFinal,
  CASE WHEN MarcaBancarizadoU06M = 1 AND RentaEvaluacion >= 300000 THEN DeudaConsumo / RentaEvaluacion END AS Leverage,
  {cross_sql('MarcaBancarizadoU01M')} AS SegmentosEvaluar, {cross_sql('MarcaBancarizadoU06M')} AS SegmentosEvaluarU06M,
  {channel_sql('TenenciaRetailML', 'Retail')} AS TipoSegmentoRetail, {channel_sql('TenenciaPatrimonio', 'Patrimonio')} AS TipoSegmentoPatrimonio,
  {channel_sql('MarcaBancarizadoU06M', 'Bancarizado')} AS TipoSegmentoBancarizado,
  CASE WHEN TenenciaPatrimonio = 1 THEN if(RentaEvaluacion > 0, 'Renta y ', '') || 'Patrimonio'
       ELSE if(RentaEvaluacion > 0, 'Renta', 'Sin renta ni patrimonio') END AS SegmentoCliente,
  CASE WHEN MontoPropiedad > 0 THEN if(MontoVehiculos > 0, 'Propiedad + Vehiculo', 'Propiedad')
       ELSE if(MontoVehiculos > 0, 'Vehiculo', 'Sin patrimonio') END AS TipoPatrimonio,
  {ladder_sql('CONSUMER_DEBT', 'coalesce(DeudaConsumo, 0)')} AS TramoDeuda,
  {ladder_sql('DEBT_RATIO', 'RatioDeudaLineaMasDeudaU03M')} AS TramoRatioDeudaLineaMasDeudaU03M,
  CASE WHEN RentaEstimada = 0 THEN '00. Sin renta' ELSE {ladder_sql('DTI', 'DTI')} END AS TramoDTI,
  {ladder_sql('EVALUATED_INCOME', 'RentaEvaluacion')} AS TramoRentaEvaluacion, {ladder_sql('PILOT_INCOME', 'RentaPiloto')} AS TramoRentaPiloto,
  CAST(RentaEvaluacion > 0 AS INT) AS TenenciaRentaEvaluacion, CAST(coalesce(RentaPrevisionU03M, 0) > 0 AS INT) AS TenenciaRentaPrevisionValida,
  {ladder_sql('LIMIT', 'Cupo')} AS TramoCupo, {ladder_sql('AGE', 'EdadMeses')} AS TramoEdad, {ladder_sql('WEALTH', 'MontoPatrimonio')} AS TramoPatrimonio,
  {waterfall_sql(SPONTANEOUS)} AS CambiosEspontaneo,
  {waterfall_sql(PREAPPROVED)} AS CambiosPreaprobado, {waterfall_sql(PREAPPROVED)} AS CambiosPreaprobadoSinT
FROM d_enriched"""
STEPS["d_tracking"] = f"SELECT *, {rollup_sql()} AS CambiosTotal FROM d_segmented"
_sums = ", ".join(f"sum({c}) AS {c}" for c in SUMS)
STEPS["q_portfolio_grouped"] = f"SELECT {', '.join(KEYS)}, count(Contrato) AS N, {_sums} FROM d_segmented GROUP BY ALL"
STEPS["q_portfolio_grouped_changes"] = f"SELECT {', '.join(KEYS)}, CambiosTotal, count(Contrato) AS N, {_sums} FROM d_tracking GROUP BY ALL"
STEPS["q_portfolio_grouped_refreshed"] = f"""
SELECT {', '.join(KEYS)}, count(Contrato) AS N, {_sums} FROM (
  SELECT * REPLACE (2 * Cupo AS Cupo) FROM d_segmented WHERE FechaFoto = DATE '2022-06-01' AND IdCliente % 2 = 0
  UNION ALL SELECT * FROM d_segmented WHERE FechaFoto <> DATE '2022-06-01') GROUP BY ALL"""

_NODES = {**DUCK_SOURCES, **STEPS}
_WORD = re.compile(r"\b[a-z_0-9]+\b")


def with_inputs(sql: str) -> str:
    """``sql`` preceded by every input and step it needs, in order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in _NODES and word not in order:
                visit_node(word)

    def visit_node(name: str) -> None:
        body = _NODES[name]
        for word in _WORD.findall(body):
            if word in _NODES and word not in order and word != name:
                visit_node(word)
        if name not in order:
            order.append(name)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_NODES[n]})" for n in order) + "\n" + sql


def step_sql(name: str) -> str:
    return with_inputs(f"SELECT * FROM {name}")
