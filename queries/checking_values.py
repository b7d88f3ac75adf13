"""Fixed values of the checking SQL, spelled out apart from the library so that a slip on either side shows.

A band is a list of ``operator bound label`` lines in order, with what is left over and NULL where it has a label of
its own. A rule is ``code | condition`` on the columns of the segmented table.
"""

# Bands, and the rules of both policies in order
BANDS = {
    "AGE": """
        < 252 01. < 21
        < 300 02. =21-25
        < 360 03. =25-30
        < 420 04. =30-35
        < 480 05. =35-40
        < 540 06. =40-45
        < 600 07. =45-50
        < 660 08. =50-55
        < 720 09. =55-60
        < 780 10. =60-65
        < 840 11. =65-70
        < 900 12. =70-75
        >= 900 13. >= 75
        ELSE Otros
    """,
    "CONSUMER_DEBT": """
        = 0 00. Sin deuda
        < 100000 01. < 100
        < 500000 02. 100-500
        < 1000000 03. 500-1MM
        < 5000000 04. 1-5 MM
        < 10000000 05. 5-10MM
        < 20000000 06. 10-20MM
        < 30000000 07. 20-30MM
        < 40000000 08. 30-40MM
        < 50000000 09. 40-50MM
        >= 50000000 10. >= 50MM
        ELSE Otros
    """,
    "DEBT_RATIO": """
        NULL 00. Sin info
        = -1 00. Sin info
        <= 0.1 01. <= 10%
        <= 0.2 02. 10-20%
        <= 0.3 03. 20-30%
        <= 0.4 04. 30-40%
        <= 0.5 05. 40-50%
        <= 0.6 06. 50-60%
        <= 0.7 07. 60-70%
        <= 0.8 08. 70-80%
        <= 0.9 09. 80-90%
        <= 1 10. 90-100%
        > 1 11. > 100%
        ELSE Otros
    """,
    "DTI": """
        = -1 00. Sin DTI
        < 0.1 01. <= 10%
        <= 0.2 02. 10-20%
        <= 0.3 03. 20-30%
        <= 0.4 04. 30-40%
        <= 0.5 05. 40-50%
        <= 0.6 06. 50-60%
        <= 0.7 07. 60-70%
        <= 0.8 08. 70-80%
        <= 0.9 09. 80-90%
        <= 1 10. 90-100%
        <= 1.2 11. 100-120%
        <= 1.5 12. 120-150%
        <= 2 13. 150-200%
        > 2 14. > 200%
        ELSE Otros
    """,
    "EVALUATED_INCOME": """
        <= 0 01. Sin renta
        <= 300000 02. <= 300
        <= 400000 03. 300-=400
        <= 500000 04. 400-=500
        <= 600000 05. 500-=600
        <= 700000 06. 600-=700
        <= 800000 07. 700-=800
        <= 900000 08. 800-=900
        <= 1000000 09. 900-=1 MM
        <= 1200000 10. 1-=1.2 MM
        <= 1500000 11. 1.2-=1.5 MM
        <= 1700000 12. 1.5-=1.7 MM
        <= 2000000 13. 1.7-=2.0 MM
        > 2000000 14. > 2.0 MM
        ELSE Otros
    """,
    "GRADE": """
        < 0.0121 01. AAA
        < 0.0221 02. AA
        < 0.0325 03. A
        < 0.0437 04. B
        < 0.0622 05. C
        < 0.0735 06. D
        < 0.088 07. E
        < 0.101 08. F
        < 0.1276 09. G
        <= 1 10. H
        ELSE Otros
    """,
    "GRADE_BEFORE": """
        < 0.015 01. AAA
        < 0.032 02. AA
        < 0.055 03. A
        < 0.08 04. B
        < 0.102 05. C
        < 0.1542 06. D
        < 0.1736 07. E
        < 0.203 08. F
        < 0.2397 09. G
        <= 1 10. H
        ELSE Otros
    """,
    "LIMIT": """
        <= 0 01. Sin cupo
        <= 100000 02. <= 100
        <= 300000 03. 100-=300
        <= 400000 04. 300-=400
        <= 500000 05. 400-=500
        <= 600000 06. 500-=600
        <= 700000 07. 600-=700
        <= 800000 08. 700-=800
        <= 900000 09. 800-=900
        <= 1000000 10. 900-=1 MM
        <= 1200000 11. 1-=1.2 MM
        <= 1500000 12. 1.2-=1.5 MM
        <= 1700000 13. 1.5-=1.7 MM
        <= 2000000 14. 1.7-=2.0 MM
        > 2000000 15. > 2.0 MM
        ELSE Otros
    """,
    "PILOT_INCOME": """
        <= 0 01. Sin renta
        <= 300000 02. <= 300
        <= 500000 03. <=500
        <= 800000 04. <=800
        <= 1500000 05. <=1.5 MM
        <= 2000000 06. <=2.0 MM
        > 2000000 07. > 2.0 MM
        ELSE Otros
    """,
    "PROBABILITY": """
        <= 0.05 01. <= 5%
        <= 0.1 02. >5 <=10%
        <= 0.15 03. >10 <=15%
        <= 0.2 04. >15 <=20%
        <= 0.25 05. >20 <=25%
        ELSE 06. >25%
    """,
    "WEALTH": """
        = 0 00. Sin patrimonio
        <= 10000000 01. <= 10MM
        <= 20000000 02. 10-20MM
        <= 30000000 03. 20-30MM
        <= 40000000 04. 30-40MM
        <= 50000000 05. 40-50MM
        <= 100000000 06. 50-100MM
        > 100000000 07. > 100MM
        ELSE Otros
    """,
}

SPONTANEOUS = """
    RECHAZO POLITICA MAYO22 PD>0.25 | ProbPreaprobados_Antiguo > 0.25
    RECHAZO POLITICA MAYO22 RENTA | coalesce(RentaEvaluacion, 0) > 0 AND coalesce(RentaEvaluacion, 0) < 400000
    RECHAZO POLITICA MAYO22 DUEÑA DE CASA | TipoEmpleo = 'Dueña de Casa'
    RECHAZO POLITICA MAYO22 EDAD<21 | EdadMeses < 252
    RECHAZO POLITICA MAYO22 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados_Antiguo > 0.15
    RECHAZO POLITICA MAYO22 BANCARIZADO | coalesce(MarcaBancarizadoU06M, 0) = 1 AND ProbPreaprobados_Antiguo > 0.25
    RECHAZO POLITICA MAYO22 NB ConInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND ProbPreaprobados_Antiguo > 0.25
    RECHAZO POLITICA MAYO22 NB SinInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND ProbPreaprobados_Antiguo > 0.25
    RECHAZO MODELO MAYO22 BANCARIZADO | ClasificacionPreaprobados = 'BANCARIZADO MAYOR 21' AND ProbPreaprobados_Antiguo > 0.25
    RECHAZO MODELO MAYO22 NOBANCARIZADO | ClasificacionPreaprobados = 'NO BANCARIZADO MAYOR 21' AND ProbPreaprobados_Antiguo > 0.25
    RECHAZO MODELO MAYO22 EXTRANJERO NB | ClasificacionPreaprobados = 'EXTRANJERO NO BANCARIZADO' AND ProbPreaprobados_Antiguo > 0.25
    RECHAZO MODELO MAYO22 MENOR 21 | ClasificacionPreaprobados = 'MENOR 21'
    RECHAZO POLITICA OCTUBRE22 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados > 0.1
    RECHAZO POLITICA OCTUBRE22 BANCARIZADO | coalesce(MarcaBancarizadoU06M, 0) = 1 AND ProbPreaprobados > 0.13
    RECHAZO POLITICA OCTUBRE22 NB ConInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (TenenciaPatrimonio > 0 OR TenenciaRetailML > 0) AND ProbPreaprobados > 0.13
    RECHAZO POLITICA OCTUBRE22 NB SinInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND ProbPreaprobados > 0.1
    RECHAZO MODELO OCTUBRE22 BANCARIZADO | ClasificacionPreaprobados = 'BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.13
    RECHAZO MODELO OCTUBRE22 NOBANCARIZADO | ClasificacionPreaprobados = 'NO BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.1
    RECHAZO MODELO OCTUBRE22 EXTRANJERO NB | ClasificacionPreaprobados = 'EXTRANJERO NO BANCARIZADO' AND ProbPreaprobados > 0.1
    RECHAZO POLITICA NOVIEMBRE22 BANCARIZADO | coalesce(MarcaBancarizadoU06M, 0) = 1 AND ProbPreaprobados > 0.12
    RECHAZO POLITICA NOVIEMBRE22 NB ConInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND ProbPreaprobados > 0.12
    RECHAZO POLITICA NOVIEMBRE22 NB SinInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND ProbPreaprobados > 0.09
    RECHAZO MODELO NOVIEMBRE22 BANCARIZADO | ClasificacionPreaprobados = 'BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.12
    RECHAZO MODELO NOVIEMBRE22 NOBANCARIZADO | ClasificacionPreaprobados = 'NO BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.1
    RECHAZO MODELO NOVIEMBRE22 EXTRANJERO NB | ClasificacionPreaprobados = 'EXTRANJERO NO BANCARIZADO' AND ProbPreaprobados > 0.1
    RECHAZO POLITICA FEBRERO23 NB SinInfo Extranjero | coalesce(MarcaBancarizadoU06M, 0) = 1 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND Nacionalidad = 'Extranjero'
    RECHAZO POLITICA FEBRERO23 NB SinInfo Chileno | coalesce(MarcaBancarizadoU06M, 0) = 1 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND Nacionalidad = 'Chileno' AND ProbPreaprobados > 0.09
    RECHAZO POLITICA FEBRERO23 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados > 0.09
    RECHAZO POLITICA FEBRERO23 EDAD<25 SinInfo Extranjero | EdadMeses < 300 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND Nacionalidad = 'Extranjero' AND ProbPreaprobados > 0.07
"""

PREAPPROVED = """
    RECHAZO POLITICA AGOSTO22 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados_Antiguo > 0.15
    RECHAZO POLITICA AGOSTO22 Bancarizado | coalesce(MarcaBancarizadoU06M, 0) = 1 AND ProbPreaprobados_Antiguo > 0.2
    RECHAZO POLITICA AGOSTO22 NBConPatRet | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (TenenciaPatrimonio > 0 OR TenenciaRetailML > 0) AND ProbPreaprobados_Antiguo > 0.2
    RECHAZO POLITICA AGOSTO22 NBSinPatRet | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(TenenciaRetailML, 0) = 0) AND ProbPreaprobados_Antiguo > 0.16
    RECHAZO POLITICA OCTUBRE22 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados > 0.11
    RECHAZO POLITICA OCTUBRE22 BANCARIZADO | coalesce(MarcaBancarizadoU06M, 0) = 1 AND ProbPreaprobados > 0.13
    RECHAZO POLITICA OCTUBRE22 NB ConInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND ProbPreaprobados > 0.13
    RECHAZO POLITICA OCTUBRE22 NB SinInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND ProbPreaprobados > 0.1
    RECHAZO MODELO OCTUBRE22 BANCARIZADO | ClasificacionPreaprobados = 'BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.13
    RECHAZO MODELO OCTUBRE22 NOBANCARIZADO | ClasificacionPreaprobados = 'NO BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.13
    RECHAZO MODELO OCTUBRE22 EXTRANJERO NB | ClasificacionPreaprobados = 'EXTRANJERO NO BANCARIZADO' AND ProbPreaprobados > 0.13
    RECHAZO MODELO OCTUBRE22 EDAD<21 | ClasificacionPreaprobados = 'MENOR 21' AND ProbPreaprobados > 0.09
    RECHAZO POLITICA NOVIEMBRE22 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados > 0.1
    RECHAZO POLITICA NOVIEMBRE22 BANCARIZADO | coalesce(MarcaBancarizadoU06M, 0) = 1 AND ProbPreaprobados > 0.12
    RECHAZO POLITICA NOVIEMBRE22 NB ConInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (TenenciaPatrimonio > 0 OR TenenciaRetailML > 0) AND ProbPreaprobados > 0.12
    RECHAZO POLITICA NOVIEMBRE22 NB SinInfo | coalesce(MarcaBancarizadoU06M, 0) = 0 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND ProbPreaprobados > 0.09
    RECHAZO MODELO NOVIEMBRE22 BANCARIZADO | ClasificacionPreaprobados = 'BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.12
    RECHAZO MODELO NOVIEMBRE22 NOBANCARIZADO | ClasificacionPreaprobados = 'NO BANCARIZADO MAYOR 21' AND ProbPreaprobados > 0.12
    RECHAZO MODELO NOVIEMBRE22 EXTRANJERO NB | ClasificacionPreaprobados = 'EXTRANJERO NO BANCARIZADO' AND ProbPreaprobados > 0.12
    RECHAZO MODELO NOVIEMBRE22 EDAD<21 | ClasificacionPreaprobados = 'MENOR 21' AND ProbPreaprobados > 0.08
    RECHAZO POLITICA FEBRERO23 NB SinInfo Extranjero | coalesce(MarcaBancarizadoU06M, 0) = 1 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND Nacionalidad = 'Extranjero'
    RECHAZO POLITICA FEBRERO23 NB SinInfo Chileno | coalesce(MarcaBancarizadoU06M, 0) = 1 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND Nacionalidad = 'Chileno' AND ProbPreaprobados > 0.09
    RECHAZO POLITICA FEBRERO23 EDAD<25 | EdadMeses < 300 AND ProbPreaprobados > 0.09
    RECHAZO POLITICA FEBRERO23 EDAD<25 SinInfo Extranjero | EdadMeses < 300 AND (coalesce(TenenciaPatrimonio, 0) = 0 AND coalesce(ComprasSU12M, 0) + coalesce(ComprasFU12M, 0) = 0) AND Nacionalidad = 'Extranjero' AND ProbPreaprobados > 0.07
"""

# Labels of the month offsets, summed columns, keys and sums of the reports
MONTH_LABELS = ["Mmenos1", "M0", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "M10"]
SUMMED = [
    "FCupoAnterior", "FCupoActual", "MontoAumento", "Porc_Aumento", "DeudaL1", "Utilizacion", "DeudaMorosa30",
    "DeudaTotalL1",
]
KEYS = [
    "FechaFoto", "TipoEmpleo", "TenenciaRetailML", "TramoProbabilidadPreap", "SegmentoPreaprobados",
    "TramoPdProvisiones", "MarcaPreaprobado", "TramoRentaEvaluacion", "TramoEdad", "TipoSegmentoBancarizado",
    "SegmentoAplicaVintage", "TramoCupo", "TramoPatrimonio",
]
SUMS = [
    "DeudaTotalMes03", "DeudaTotalMes06", "ProbPreapFinal", "Pd_Provisiones", "Leverage", "Cupo",
    "DeudaMorosa30Mes03", "DeudaMorosa30Mes06", "DeudaMorosa60Mes06",
]
