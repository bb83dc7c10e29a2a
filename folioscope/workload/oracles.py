"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from folioscope import fixed_values as fv
from folioscope.workload.oracle_books import (customer_id, folio, money, supplier_id,
                                              with_tables)

_SQL: dict[str, str] = {}

_RATIO = 1.3


def oracles() -> dict[str, str]:
    return dict(_SQL)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _money(column: str) -> str:
    return f"'$' || format('{{:,.2f}}', cast({column} as double))"


# --- expressions used more than once ----------------------------------------------

_THRESHOLDS = """
select greatest(max(case when rn = least(cast(floor(0.5 * n) as bigint), n - 1) then monto end),
                1000.00) as ciclo,
       greatest(max(case when rn = least(cast(floor(0.75 * n) as bigint), n - 1) then monto end),
                5000.00) as ingreso
from (select monto, row_number() over (order by monto) - 1 as rn, count(*) over () as n
      from ledger)"""

_NETWORK = """
select cuenta_origen_rfc as source, cuenta_destino_rfc as target, sum(monto) as m,
       count(tx_id) as n from ledger group by 1, 2"""


def _paths(minimum: str) -> str:
    return f"""
select source as start, target as last, [source, target] as nodes, [m] as legs, m as mn, m as mx
from network where source < target and m > 0 and m >= {minimum}
union all
select p.start, e.target, list_append(p.nodes, e.target), list_append(p.legs, e.m),
       least(p.mn, e.m), greatest(p.mx, e.m)
from paths p join network e on e.source = p.last
where p.last <> p.start and e.source <> e.target and e.m > 0 and e.m >= {minimum}
  and e.target >= p.start and cast(greatest(p.mx, e.m) as double)
      <= {_RATIO} * 1.000000001 * cast(least(p.mn, e.m) as double)
  and case when e.target = p.start then len(p.nodes) >= 3
           else len(p.nodes) < 8 and not list_contains(p.nodes, e.target) end"""


_CYCLES = f"""
select nodes[1:len(nodes) - 1] as ciclo, len(nodes) - 1 as num_saltos, mn, mx, legs
from paths where last = start and cast(mx as double) / cast(mn as double) <= {_RATIO}"""

_MEMBERS = "select distinct unnest(ciclo) as rfc from cycles"


def _cycles(minimum: str) -> dict:
    return {"network": _NETWORK, "paths": _paths(minimum), "cycles": _CYCLES,
            "members": _MEMBERS}


_FOLD = "strip_accents(lower({}))"
_GENERIC = "(contains({0}, 'economy') or contains({0}, 'promo'))"

_ISSUED = """
select distinct emisor_rfc as rfc, descripcion
from items join invoices on invoice_uuid = uuid where descripcion <> ''"""

_MATERIALITY = {
    "issued": _ISSUED,
    "received": """
select i.uuid, receptor_rfc as rfc, _row as fila, descripcion as concepto
from items join invoices i on invoice_uuid = uuid""",
    "pairs": "select distinct rfc, concepto from received",
    "descriptions": """
select distinct c.rfc, unnest(descripciones_esperadas) as descripcion
from catalog c where c.rfc in (select rfc from pairs)
union
select rfc, descripcion from issued
where rfc in (select rfc from pairs) and rfc not in (select rfc from catalog)""",
    "heads": """
select rfc, 'CATALOGO' as fuente, razon_social, giro from catalog
where rfc in (select rfc from pairs)
union all
select d.rfc, 'HISTORIAL', coalesce(e.razon_social, d.rfc),
       'inferido de su propio historial de facturación'
from (select distinct rfc from issued where rfc in (select rfc from pairs)
      and rfc not in (select rfc from catalog)) d
left join entities e on e.rfc = d.rfc""",
    "words": f"""
select distinct rfc, palabra
from (select rfc, unnest(string_split_regex({_FOLD.format('descripcion')}, '\\s+')) as palabra
      from descriptions)
where length(palabra) > 4 and palabra not in {_in(fv.PROFILE_STOP_WORDS)}""",
    "fits": f"""
select distinct p.rfc, p.concepto from pairs p join words w
on w.rfc = p.rfc and contains({_FOLD.format('p.concepto')}, w.palabra)""",
    "judged": f"""
select p.rfc, p.concepto, h.rfc is not null as conocido, f.rfc is not null as corresponde,
       {_GENERIC.format(_FOLD.format('p.concepto'))} as generico, h.razon_social, h.giro,
       case when h.rfc is not null then f.rfc is not null
            or not {_GENERIC.format(_FOLD.format('p.concepto'))} end as match
from pairs p left join heads h on h.rfc = p.rfc
left join fits f on f.rfc = p.rfc and f.concepto = p.concepto""",
    "immaterial": """
select distinct r.uuid, r.rfc from received r join judged j
on j.rfc = r.rfc and j.concepto = r.concepto where j.match = false""",
}

_KIND = """case when tipo in ('factura', 'transferencia') then tipo
            when uuid <> '' then 'factura' else 'transferencia' end"""
# The identifier an item is looked up by, or else the other one.
_ID = f"""case when ({_KIND}) = 'factura' then case when uuid <> '' then uuid else tx_id end
            when tx_id <> '' then tx_id else uuid end"""


def _resolved(evidence: str = "evidence") -> dict:
    return {
        "cited": f"""
select lead_id, rfc_imputado, pos, {_ID} as id, uuid, tx_id, {_KIND} as tipo
from {evidence} where trim(coalesce({_ID}, '')) <> ''""",
        "looked_up": """
select c.lead_id, c.rfc_imputado, c.pos, c.tipo, c.id, c.uuid, cast(null as varchar) as tx_id,
       i.total as monto, i.uuid is not null as existe, i.emisor_rfc as de_rfc,
       i.receptor_rfc as a_rfc, cast(null as varchar) as cfdi_uuid
from cited c left join invoices i on i.uuid = c.uuid where c.tipo = 'factura'
union all
select c.lead_id, c.rfc_imputado, c.pos, c.tipo, c.id, null, c.tx_id, l.monto,
       l.tx_id is not null, l.cuenta_origen_rfc, l.cuenta_destino_rfc, l.cfdi_uuid
from cited c left join ledger l on l.tx_id = c.tx_id where c.tipo = 'transferencia'""",
        "paid": """
select distinct lead_id, uuid from looked_up where tipo = 'factura' and existe""",
        "resolved": """
select r.*, existe and coalesce(rfc_imputado = de_rfc or rfc_imputado = a_rfc, false)
            as relevante,
       existe and coalesce(rfc_imputado = de_rfc or rfc_imputado = a_rfc, false)
       and p.uuid is null as contado_en_total
from looked_up r left join paid p on p.lead_id = r.lead_id and p.uuid = r.cfdi_uuid""",
    }


_MARKED = {
    "marked": """
select r.*,
       r.existe and r.tipo = 'factura' and exists (
           select 1 from blacklist b where b.situacion = 'DEFINITIVO'
           and b.rfc = case when r.a_rfc = r.rfc_imputado then r.de_rfc else r.a_rfc end)
           as prueba_69b,
       r.existe and r.tipo = 'factura' and exists (
           select 1 from immaterial m where m.uuid = r.uuid and m.rfc = r.rfc_imputado)
           as prueba_materialidad,
       r.existe and r.tipo = 'transferencia' and coalesce(r.a_rfc = r.rfc_imputado, false)
           and r.cfdi_uuid is null and r.monto >= (select ingreso from thresholds)
           as prueba_ingreso
from resolved r""",
}


def _decided(leads: str = "leads") -> dict:
    rejected = "'DESCARTADO_FALTA_EVIDENCIA: ' || "
    rules = [
        ("CAMPOS_FALTANTES", "rfc_imputado is null or tipo_esquema is null",
         "'el lead está incompleto.'"),
        ("RFC_DESCONOCIDO", "e_rfc is null",
         "'el RFC imputado ''' || rfc_imputado || ''' no existe en los libros.'"),
        ("SIN_TIPIFICAR", "trim(tipo_esquema) = ''",
         "'la revisión de ' || rfc_imputado || ' no tipificó ningún esquema; no hay acusación.'"),
        ("ESQUEMA_DESCONOCIDO", f"tipo_esquema not in {_in(fv.SCHEMES)}",
         "'''' || tipo_esquema || ''' no es una tipología reconocida ("
         + ", ".join(sorted(fv.SCHEMES)) + ").'"),
        ("SIN_EVIDENCIA", "n is null", "'no hay evidencia referenciada.'"),
        ("EVIDENCIA_INEXISTENTE", "ausente is not null",
         "'la evidencia citada ''' || ausente || ''' no existe en los libros.'"),
        ("EVIDENCIA_AJENA", "ajena is not null",
         "'la evidencia ''' || ajena || ''' existe pero no involucra a ' || rfc_imputado || '.'"),
        ("MONTO_NO_POSITIVO", "total <= 0",
         "'la evidencia verificada no suma un monto mayor a cero.'"),
        ("SIN_PRUEBA_69B", "tipo_esquema = 'EFOS_69B' and not prueba_69b",
         "'ninguna factura citada tiene una contraparte DEFINITIVO en la lista 69-B.'"),
        ("SIN_PRUEBA_CICLO", "tipo_esquema = 'KICKBACK_CIRCULAR' and m_rfc is null",
         "'ningún ciclo de transferencias incluye a ' || rfc_imputado || '.'"),
        ("SIN_PRUEBA_INGRESO", "tipo_esquema = 'INGRESO_NO_DECLARADO' and not prueba_ingreso",
         "'ninguna transferencia citada entró a ' || rfc_imputado || ' sin CFDI por al menos ' || "
         + _money("(select ingreso from thresholds)") + " || '.'"),
        ("SIN_PRUEBA_MATERIALIDAD",
         "tipo_esquema in ('SIN_MATERIALIDAD', 'EMPRESA_FACHADA') and not prueba_materialidad",
         "'ninguna inconsistencia de materialidad verificable para ' || rfc_imputado || '.'"),
    ]
    code = " ".join(f"when {c} then '{n}'" for n, c, _ in rules)
    reason = " ".join(f"when {c} then {rejected}{t}" for _, c, t in rules)
    return {
        "per_lead": """
select lead_id, count(*) as n, arg_min(case when not existe then id end,
           case when not existe then (pos, id) end) as ausente,
       arg_min(case when existe and not relevante then id end,
           case when existe and not relevante then (pos, id) end) as ajena,
       sum(case when contado_en_total then monto end) as total,
       bool_or(prueba_69b) as prueba_69b, bool_or(prueba_materialidad) as prueba_materialidad,
       bool_or(prueba_ingreso) as prueba_ingreso
from marked group by lead_id""",
        "joined": f"""
select l.lead_id, l.rfc_imputado, l.tipo_esquema, coalesce(e.razon_social, '') as razon_social,
       e.rfc as e_rfc, m.rfc as m_rfc, p.n, p.ausente, p.ajena, coalesce(p.total, 0) as total,
       p.prueba_69b, p.prueba_materialidad, p.prueba_ingreso
from {leads} l left join per_lead p on p.lead_id = l.lead_id
left join entities e on e.rfc = l.rfc_imputado left join members m on m.rfc = l.rfc_imputado""",
        "decided": f"""
select lead_id, rfc_imputado, razon_social, tipo_esquema, total as monto_total_evidencia,
       case {code} else '' end as regla_fallida,
       case {reason} else 'CONFIRMADO_CON_PRUEBA' end as razon
from joined""",
        "verdicts": """
select *, regla_fallida = '' as confirmado,
       case when regla_fallida = '' then 'CONFIRMADO_CON_PRUEBA'
            else 'DESCARTADO_FALTA_EVIDENCIA' end as estatus_dictamen
from decided""",
    }


_BASE = "entities blacklist invoices items ledger catalog leads evidence"


def _draft_case(select: str, **more) -> str:
    return with_tables(select, _BASE, thresholds=_THRESHOLDS, **_cycles("1"), **_MATERIALITY,
                       **_resolved(), **_MARKED, **_decided(), **more)


# --- staging --------------------------------------------------------------------------

_TEXT_INVOICES = f"""
select o_orderkey as _row, {folio('O', 'o_orderkey')} as uuid,
       {customer_id('o_custkey')} as emisor_rfc, {customer_id('o_custkey')} as receptor_rfc,
       case when o_orderstatus in ('F', 'O') or o_totalprice > 20000 then o_orderdate end as fecha,
       {money('o_totalprice')} as amount, o_totalprice > 10000 as good_total,
       case when o_orderpriority = '1-URGENT' then ' pue' when o_orderpriority = '2-HIGH'
            then 'PPD' when o_orderpriority = '3-MEDIUM' then 'ppd '
            when o_totalprice > 15000 then 'PUE' end as metodo,
       case when o_totalprice > 12000 then '03' end as forma, o_orderstatus as s
from orders"""

_SQL["s3_violations"] = f"""
with c as (select * from customer), f as ({_TEXT_INVOICES})
select 'Entidades' as tabla, 'razon_social' as columna, c_custkey + 2 as fila,
       cast(null as varchar) as valor, 'VALOR_NULO' as regla from c where not c_acctbal >= -900
union all select 'Entidades', 'fecha_constitucion', c_custkey + 2, 'mayo', 'FECHA_INVALIDA'
from c where c_mktsegment = 'HOUSEHOLD'
union all select 'Lista_69B', 'situacion', s_suppkey + 2, 'otro', 'SITUACION_INVALIDA'
from supplier where s_acctbal >= 9000
union all select 'Lista_69B', 'publicacion_dof', s_suppkey + 2, null, 'VALOR_NULO'
from supplier where s_nationkey >= 20
union all select 'Facturas', 'fecha_emision', _row + 2, null, 'VALOR_NULO' from f
where fecha is null
union all select 'Facturas', 'total', _row + 2, 'n/d', 'NUMERO_INVALIDO' from f
where not good_total
union all select 'Facturas', 'metodo_pago', _row + 2, null, 'METODO_INVALIDO' from f
where metodo is null
union all select 'Facturas', 'forma_pago', _row + 2, null, 'VALOR_NULO' from f where forma is null
union all select 'Partidas', 'valor_unitario', l_orderkey * 10 + l_linenumber + 2, 'x',
       'NUMERO_INVALIDO' from lineitem where l_extendedprice <= 1000
union all select 'Transacciones_Bancarias', 'cuenta_destino_rfc', event_id + 2, null,
       'VALOR_NULO' from events where value <= 0.5
union all select 'Transacciones_Bancarias', 'monto', event_id + 2, 'mucho', 'NUMERO_INVALIDO'
from events where value >= 300"""

_SQL["s4_cell_parsers"] = f"""
select o_orderkey,
       case when o_orderstatus in ('F', 'O') then cast(cast(o_orderdate as date) as varchar) end
           as fecha,
       case when o_orderpriority <> '5-LOW' then cast({money('o_totalprice')} as double) end
           as monto,
       o_orderpriority <> '5-LOW' as bandera
from orders"""

_SQL["s5a_entities"] = f"""
select {customer_id('c_custkey')} as rfc, c_name as razon_social,
       case when c_mktsegment = 'BUILDING' then '2011-05-12'
            when c_mktsegment = 'MACHINERY' then '2011-05-12' end as fecha_constitucion,
       case when c_acctbal > 0 then c_mktsegment end as representante_legal,
       lpad(cast(c_nationkey as varchar), 5, '0') as codigo_postal,
       c_nationkey < 5 or (c_nationkey >= 10 and c_nationkey < 15) as es_empresa_auditada
from customer where c_acctbal >= -900 and c_mktsegment <> 'HOUSEHOLD'"""

_TEXT_LIST = f"""
select {supplier_id('s_suppkey')} as rfc,
       case when s_acctbal < 0 then 'DEFINITIVO' when s_acctbal < 5000 then 'PRESUNTO'
            else 'DESVIRTUADO' end as situacion, '2024-03-01' as publicacion_dof,
       case when s_acctbal > 1000 then cast({money('s_acctbal')} as double) else 0.0 end
           as monto_presunto_total
from supplier where s_acctbal < 9000 and s_nationkey < 20"""
_SQL["s5b_blacklist"] = _TEXT_LIST

_SQL["s5c_invoices"] = f"""
with f as ({_TEXT_INVOICES})
select uuid, emisor_rfc, receptor_rfc, cast(fecha as varchar) as fecha_emision,
       cast(amount as double) as subtotal, cast(amount as double) as total,
       upper(trim(metodo)) as metodo_pago, forma as forma_pago,
       case when s = 'O' then 'CANCELADO' else 'VIGENTE' end as estado_cfdi
from f where fecha is not null and good_total and metodo is not null and forma is not null
  and s <> 'P'"""
# Status P dates are written yyyy/MM/dd, which a timestamp cell does not accept.
_SQL["s3_violations"] += """
union all select 'Facturas', 'fecha_emision', _row + 2, strftime(fecha, '%Y/%m/%d'),
       'FECHA_INVALIDA' from f where s = 'P' and fecha is not null"""

_SQL["s5d_items"] = f"""
select {folio('O', 'l_orderkey')} as invoice_uuid, cast(l_partkey as varchar) as clave_prod_serv,
       'parte ' || l_returnflag || ' ' || l_linestatus as descripcion,
       cast(cast(l_quantity as decimal(10,2)) as double) as cantidad,
       cast({money('l_extendedprice')} as double) as valor_unitario,
       cast({money('l_extendedprice')} as double) as importe
from lineitem where l_extendedprice > 1000"""

_SQL["s5e_ledger"] = f"""
select {folio('E', 'event_id')} as tx_id, 'U' || cast(user_id as varchar) as cuenta_origen_rfc,
       event_type as cuenta_destino_rfc, cast(date_trunc('second', ts) as varchar) as fecha_hora,
       cast({money('value')} as double) as monto, cast(null as varchar) as referencia_bancaria,
       case when event_type = 'click' then 'c1' end as cfdi_uuid
from events where value > 0.5 and value < 300"""

_SQL["s6_last_row_wins"] = f"""
select user_id, arg_max(event_type, event_id) as event_type,
       cast(arg_max({money('value')}, event_id) as double) as value
from events group by user_id"""

_SQL["s6_blacklist_merge"] = with_tables("""
select rfc, situacion, cast(publicacion_dof as varchar) as publicacion_dof,
       cast(monto_presunto_total as double) as monto_presunto_total
from blacklist where rfc not in (select rfc from incoming)
union all select * from incoming""", "blacklist", incoming=_TEXT_LIST)

_SQL["s1_read_table"] = """
select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_acctbal as varchar) as c_acctbal,
       c_mktsegment from customer"""
_SQL["s1_row_numbers"] = """
select 0 as primera, count(*) - 1 as ultima, count(*) as distintas from lineitem"""
_SQL["s8_stored_invoices"] = with_tables("""
select uuid, emisor_rfc, receptor_rfc, cast(total as double) as total, metodo_pago, estado_cfdi
from invoices""", "invoices")
_SQL["s8_expired_loads"] = with_tables("""
select 1 as version, count(*) as n, cast(sum(total) as double) as total from invoices
union all
select 3, count(*), cast(sum(total) as double) from invoices
where metodo_pago = 'PPD'""", "invoices")
_SQL["s17c_archived_cases"] = _draft_case("""
select lead_id, rfc_imputado, tipo_esquema,
       cast(monto_total_evidencia as double) as monto_total_evidencia
from verdicts where confirmado""")
_SQL["s17d_deleted_run"] = _draft_case("""
select count(*) as n_leads, 1 as n_expedientes, true as estaba, false as sigue, true as borrado
from verdicts""")
_SQL["s7_reference_violations"] = with_tables("""
select tabla, columna, valor, count(*) as n from (
  select 'invoices' as tabla, 'emisor_rfc' as columna, emisor_rfc as valor from bills
  where emisor_rfc not in (select rfc from entities)
  union all select 'invoices', 'receptor_rfc', receptor_rfc from bills
  where receptor_rfc not in (select rfc from entities)
  union all select 'invoice_items', 'invoice_uuid', invoice_uuid from items
  where invoice_uuid not in (select uuid from bills)
  union all select 'bank_ledger', 'cuenta_origen_rfc', cuenta_origen_rfc from moves
  where cuenta_origen_rfc not in (select rfc from entities)
  union all select 'bank_ledger', 'cuenta_destino_rfc', cuenta_destino_rfc from moves
  where cuenta_destino_rfc not in (select rfc from entities)
  union all select 'bank_ledger', 'cfdi_uuid', cfdi_uuid from moves
  where cfdi_uuid is not null and cfdi_uuid not in (select uuid from bills))
group by 1, 2, 3""", "entities invoices items ledger",
    bills="""select case when estado_cfdi = 'CANCELADO' then 'x' || uuid else uuid end as uuid,
       case when total > 50000 then lower(emisor_rfc) else emisor_rfc end as emisor_rfc,
       case when total < 2000 then lower(receptor_rfc) else receptor_rfc end as receptor_rfc
from invoices""",
    moves="""select case when monto > 50000 then lower(cuenta_origen_rfc) else cuenta_origen_rfc
            end as cuenta_origen_rfc,
       case when monto < 2000 then lower(cuenta_destino_rfc) else cuenta_destino_rfc
            end as cuenta_destino_rfc, cfdi_uuid from ledger""")

_SQL["s9_load_counts"] = with_tables("""
select 'entities' as tabla, count(*) as n from entities
union all select 'blacklist_69b', count(*) from blacklist
union all select 'invoices', count(*) from invoices
union all select 'invoice_items', count(*) from items
union all select 'bank_ledger', count(*) from ledger""",
    "entities blacklist invoices items ledger")

# Two rows of a list in a row may name the same ID, and the later one may be older.
_LISTS = f"""
select 1 as lista, s_suppkey as fila, {supplier_id('(s_suppkey // 2)')} as rfc, s_name as razon_social,
       'DEFINITIVO' as situacion,
       date '2020-01-01' + cast(s_nationkey * 90 as integer) as publicacion_dof
from supplier where s_acctbal > 0 and s_nationkey < 22
union all
select 2, c_custkey, case when c_mktsegment = 'FURNITURE' then {supplier_id('(c_custkey // 2)')}
               else {customer_id('(c_custkey // 2)')} end, c_name, 'PRESUNTO',
       date '2020-01-01' + cast(c_nationkey * 90 as integer)
from customer where c_acctbal > 0 and c_nationkey < 22"""
_MERGED = """
select rfc, arg_max(razon_social, (lista, fila)) as razon_social,
       arg_max(situacion, (lista, fila)) as situacion,
       arg_max(publicacion_dof, (lista, fila)) as publicacion_dof from lists group by rfc"""

_SQL["s10_official_list"] = f"""
with lists as ({_LISTS})
select rfc, razon_social, situacion, cast(publicacion_dof as varchar) as publicacion_dof
from lists"""
_SQL["s11_full_catalog"] = f"""
with lists as ({_LISTS}), merged as ({_MERGED})
select rfc, razon_social, situacion, cast(publicacion_dof as varchar) as publicacion_dof
from merged order by rfc"""
_SQL["s11_recent_final"] = f"""
with lists as ({_LISTS}), merged as ({_MERGED})
select rfc, razon_social, cast(publicacion_dof as varchar) as publicacion_dof
from merged where situacion = 'DEFINITIVO' and year(publicacion_dof) >= 2024"""

_SQL["s12a_header_names"] = f"""
select doc_id, md5(nombre) as nombre, length(nombre) as largo from (
  select doc_id, regexp_replace({_FOLD.format('text')}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g') as nombre
  from documents)"""

_SQL["s13_translated"] = f"""
select {customer_id('c_custkey')} as rfc, c_name as razon_social,
       cast(null as varchar) as fecha_constitucion, cast(null as varchar) as representante_legal,
       cast(c_nationkey as varchar) as codigo_postal, cast(null as varchar) as es_empresa_auditada
from customer"""
_SQL["s12d_inferred_table"] = _SQL["s13_translated"]
_SQL["s20_canonical_input"] = """
select 'Entidades' as tabla, count(*) as n from customer
union all select unnest(['Facturas', 'Lista_69B', 'Partidas', 'Transacciones_Bancarias']), 0"""

# --- documents ------------------------------------------------------------------------------

_FIELDS = f"""
select o_orderkey as doc_id, {folio('O', 'o_orderkey')} as uuid,
       {supplier_id('o_orderkey')} as emisor_rfc,
       case when o_orderpriority <> '5-LOW' then {customer_id('o_custkey')} end as receptor_rfc,
       {customer_id('o_orderkey')} as rfc_pac,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as fecha_emision,
       case when o_orderstatus <> 'P' then {money('o_totalprice')} end as subtotal,
       case when o_orderpriority <> '4-NOT SPECIFIED' then {money('o_totalprice')} end as total,
       case when o_orderstatus <> 'P' then 'PUE' end as metodo_pago,
       case when o_orderstatus = 'F' then '03' end as forma_pago,
       case when o_orderstatus = 'F' then 'Servicio de flete' end as descripcion,
       case when o_orderstatus = 'F' then '78101800' end as clave_prod_serv,
       case when o_orderstatus = 'F' then 2.5 end as cantidad,
       cast(null as double) as valor_unitario, cast(null as double) as importe,
       case when o_orderstatus = 'F' then '64000' end as cp_emisor,
       cast(null as varchar) as cp_receptor,
       'Empresa ' || o_orderpriority as razon_social_emisor,
       'Persona ' || cast(o_custkey as varchar) as razon_social_receptor
from orders"""


def _with_fields(select: str, tables: str = "", **more) -> str:
    # The stamping provider (a customer ID) may be the buyer; then there is no receiver.
    fields = """select * replace (case when receptor_rfc <> rfc_pac then receptor_rfc end
                as receptor_rfc) from all_fields"""
    return with_tables(select, tables, all_fields=_FIELDS, fields=fields,
                       usable="select * from fields where receptor_rfc is not null "
                              "and total is not null and total <> 0", **more)


_SQL["s14_invoice_fields"] = _with_fields("""
select * replace (cast(subtotal as double) as subtotal, cast(total as double) as total,
                  cast(cantidad as double) as cantidad) from fields""")
_SQL["s15_entities"] = _with_fields("""
select doc_id, emisor_rfc as rfc, razon_social_emisor as razon_social,
       coalesce(cp_emisor, '00000') as codigo_postal, 'TRUE' as es_empresa_auditada from usable
union all
select doc_id, receptor_rfc, razon_social_receptor, '00000', 'FALSE' from usable""")
_SQL["s15_invoices"] = _with_fields("""
select doc_id, uuid, emisor_rfc, receptor_rfc, fecha_emision,
       cast(coalesce(subtotal, total) as double) as subtotal, cast(total as double) as total,
       'PUE' as metodo_pago, coalesce(forma_pago, '99') as forma_pago, 'VIGENTE' as estado_cfdi
from usable""")
_SQL["s15_items"] = _with_fields("""
select doc_id, uuid as invoice_uuid, coalesce(clave_prod_serv, '01010101') as clave_prod_serv,
       coalesce(descripcion, '(sin descripción en el documento)') as descripcion,
       cast(coalesce(cantidad, 1) as double) as cantidad, cast(total as double) as valor_unitario,
       cast(total as double) as importe from usable""")
_SQL["s15_rejected"] = _with_fields("""
select doc_id, concat_ws(', ', case when receptor_rfc is null then 'receptor_rfc' end,
       case when total is null or total = 0 then 'total' end) as faltantes
from fields where receptor_rfc is null or total is null or total = 0""")


def _check_character(rfc: str) -> str:
    alphabet = fv.TAXID_ALPHABET
    padded = f"case when length({rfc}) = 12 then ' ' || {rfc} when length({rfc}) = 13 then {rfc} end"
    total = " + ".join(
        f"(strpos('{alphabet}', substr({padded}, {i}, 1)) - 1) * {14 - i}" for i in range(1, 13))
    return (f"case when regexp_full_match(substr({padded}, 1, 12), '[{alphabet}]{{12}}') then "
            f"case ({total}) % 11 when 0 then '0' when 1 then 'A' "
            f"else cast(11 - ({total}) % 11 as varchar) end end")


_KNOWN = "select rfc from entities union select rfc from blacklist"


def _screened(read: str) -> dict:
    return {
        "known": _KNOWN,
        "read_ids": read,
        "ids": "select distinct upper(trim(rfc)) as rfc from read_ids where rfc is not null",
        "checked": f"""
select i.rfc, k.rfc is not null as conocido, {_check_character('i.rfc')} as digito_esperado
from ids i left join known k on k.rfc = i.rfc""",
        "near": """
select c.rfc, k.rfc as sugerido, levenshtein(c.rfc, k.rfc) as distancia
from checked c join known k on not c.conocido and levenshtein(c.rfc, k.rfc) <= 2""",
        "top": """
select rfc, string_agg(sugerido, ', ' order by distancia, sugerido) filter (puesto <= 3)
       as sugerencias, count(*) as n_sugerencias from (
  select *, row_number() over (partition by rfc order by distancia, sugerido) as puesto from near)
group by rfc""",
        "screened": """
select c.rfc, conocido, right(c.rfc, 1) = digito_esperado as checksum_ok, digito_esperado,
       coalesce(sugerencias, '') as sugerencias, coalesce(n_sugerencias, 0) as n_sugerencias,
       case when conocido then 'CONOCIDO'
            when right(c.rfc, 1) <> digito_esperado then 'DIGITO_INCORRECTO'
            when digito_esperado is null then 'SIN_FORMA_DE_RFC'
            else 'DIGITO_CORRECTO_NO_REGISTRADO' end as motivo,
       conocido or (coalesce(right(c.rfc, 1) = digito_esperado, false) and sugerencias is null)
           as confiable
from checked c left join top t on t.rfc = c.rfc""",
    }


# Documents name a supplier ID per order; most are unknown and near no known ID.
_SQL["s15_party_review"] = _with_fields("""
select doc_id, p.papel, p.rfc, conocido, checksum_ok, motivo, confiable from (
  select doc_id, 'emisor_rfc' as papel, emisor_rfc as rfc from usable
  union all select doc_id, 'receptor_rfc', receptor_rfc from usable) p
left join screened s on s.rfc = p.rfc""", "entities blacklist",
    **_screened("select emisor_rfc as rfc from fields union all select receptor_rfc from fields"))

_SQL["s16_document_routes"] = """
select doc_id, case when length(coalesce(text, '')) >= 200 then 'TEXTO' else 'NECESITA_OCR' end
       as ruta from documents"""

_HEADERS = f"""
select 'EXP-' || strftime(o_orderdate, '%Y-%m') as expediente_id,
       max(o_orderdate) as fecha_hora, 'libros' as archivo_origen,
       count(*) filter (o_orderstatus = 'F') as n_confirmados,
       count(*) filter (o_orderstatus <> 'F') as n_descartados,
       sum({money('o_totalprice')}) filter (o_orderstatus = 'F') as monto_total
from orders group by 1"""
_SQL["s17b_archive_listing"] = f"""
with headers as ({_HEADERS})
select expediente_id, cast(fecha_hora as varchar) as fecha_hora, archivo_origen, n_confirmados,
       n_descartados, cast(monto_total as double) as monto_total, 'plantilla' as redactado_por
from headers order by headers.fecha_hora desc, expediente_id limit 20"""
_SQL["s17f_archive_totals"] = f"""
with headers as ({_HEADERS})
select count(*) as expedientes, cast(sum(n_confirmados) as bigint) as casos_confirmados,
       cast(sum(monto_total) as double) as monto_acumulado from headers"""

_CASE_COLUMNS = f"""
select rfc_imputado, case when tipo_esquema in {_in(fv.SCHEMES)} then tipo_esquema end
       as tipo_esquema, cast(monto_total_evidencia as double) as monto_total_evidencia,
       estatus_dictamen, case when confirmado then 'Orden ' || substr(lead_id, 2) else razon end
       as justificacion_legal, 'Artículo 69-B del CFF' as regla_violada
from verdicts where rfc_imputado """
_SQL["s18_case_rows"] = _draft_case(_CASE_COLUMNS + "in (select rfc from entities)")
_SQL["s18_skipped_cases"] = _draft_case(_CASE_COLUMNS + "not in (select rfc from entities)")

_SQL["s21_parsed_drafts"] = f"""
select o_orderkey as lead_id, {customer_id('o_custkey')} as rfc_imputado,
       case when good then 'EFOS_69B' else 'SIN_MATERIALIDAD' end as tipo_esquema,
       case when good then '69-B' else '' end as regla_fiscal,
       case when good then 'Orden ' || cast(o_orderkey as varchar)
            else 'La respuesta no contiene un objeto JSON.' end as narrativa,
       case when good then 1 else 0 end as n,
       case when good then {folio('O', 'o_orderkey')} end as uuid
from (select *, o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') as good from orders)"""

# --- views, tax IDs, lists -----------------------------------------------------------------

_SQL["v1_money_network"] = with_tables("""
select source, target, cast(m as double) as total_transferido, n as numero_operaciones
from network""", "ledger", network=_NETWORK)

_BANK = """
select i.uuid, emisor_rfc, receptor_rfc, total as monto_facturado,
       coalesce(sum(l.monto), 0) as monto_pagado, total - coalesce(sum(l.monto), 0) as discrepancia
from invoices i left join ledger l on l.cfdi_uuid = i.uuid
where estado_cfdi = 'VIGENTE' group by i.uuid, emisor_rfc, receptor_rfc, total"""
_SQL["v2_invoices_against_bank"] = with_tables("""
select uuid, emisor_rfc, receptor_rfc, cast(monto_facturado as double) as monto_facturado,
       cast(monto_pagado as double) as monto_pagado, cast(discrepancia as double) as discrepancia
from bank""", "invoices ledger", bank=_BANK)

_SQL["i1_check_character"] = with_tables(
    f"select rfc, {_check_character('rfc')} as digito from entities", "entities")
_SQL["i2_valid_taxid"] = with_tables(f"""
select rfc, right(rfc, 1) = {_check_character('rfc')} as valido,
       right(rfc, 1) = {_check_character('rfc')} as sin_forma from entities""", "entities")
_SQL["i3_bounded_distance"] = """
select p_partkey, least(levenshtein(p_name, lower(p_type)), 7) as distancia from part"""
_SQL["i4_known_universe"] = with_tables(_KNOWN, "entities blacklist")

_C = customer_id("c_custkey")
_MISREAD = f"""
select case when c_mktsegment = 'BUILDING' then {_C}
            when c_mktsegment = 'MACHINERY' then left({_C}, 4) || substr({_C}, 6, 8)
            when c_mktsegment = 'HOUSEHOLD'
                 then 'S' || substr({_C}, 2, 10) || '5' || substr({_C}, 13, 1)
            when c_mktsegment = 'FURNITURE' then substr({_C}, 2, 12) || 'XYZ'
            else lower(' ' || substr({_C}, 3, 11)) end as rfc
from customer"""
_SQL["i5_nearest_known"] = with_tables("""
select leido, k.rfc as sugerido, levenshtein(leido, k.rfc) as distancia
from (select distinct upper(trim(rfc)) as leido from read_ids)
join known k on levenshtein(leido, k.rfc) <= 2""",
    "entities blacklist", known=_KNOWN, read_ids=_MISREAD)
_SQL["i6_suggestions"] = with_tables(
    "select rfc as leido, sugerido, distancia from near", "entities blacklist",
    **_screened(_MISREAD))
_SQL["i6_screening"] = with_tables(
    "select * from screened", "entities blacklist", **_screened(_MISREAD))

_SQL["l1_status_lookup"] = with_tables("""
select e.rfc, situacion, cast(publicacion_dof as varchar) as publicacion_dof,
       cast(coalesce(monto_presunto_total, 0) as double) as monto_presunto_total,
       b.rfc is not null as en_lista_69b
from entities e left join blacklist b on b.rfc = e.rfc""", "entities blacklist")
_SQL["l2_listed_as_final"] = with_tables("""
select rfc from entities where rfc in (select rfc from blacklist
where situacion = 'DEFINITIVO')""", "entities blacklist")
_SQL["c1_counts_by_status"] = with_tables("""
select situacion, count(*) as n from blacklist group by 1
union all select 'TOTAL', count(*) from blacklist""", "blacklist")
_LISTED = """select rfc, situacion, cast(publicacion_dof as varchar) as publicacion_dof,
       cast(monto_presunto_total as double) as monto_presunto_total from blacklist """
_SQL["c2_search"] = with_tables(
    _LISTED + "where regexp_matches(rfc, '^[A-H].*[0-4]')", "blacklist")
_SQL["c2_search_page"] = with_tables(
    _LISTED + """where situacion in ('DEFINITIVO', 'PRESUNTO')
order by blacklist.publicacion_dof desc, rfc limit 500""", "blacklist")

# --- thresholds and cycles --------------------------------------------------------------------

_SQL["t1_percentiles"] = with_tables("""
select cast(fraccion as double) as fraccion, cast(monto as double) as monto
from (values (0.0), (0.25), (0.5), (0.75), (0.9), (1.0)) f(fraccion)
join (select monto, row_number() over (order by monto) - 1 as rn, count(*) over () as n
      from ledger) on rn = least(cast(floor(fraccion * n) as bigint), n - 1)""", "ledger")
_SQL["t2_t3_thresholds"] = with_tables(
    "select cast(ciclo as double) as ciclo, cast(ingreso as double) as ingreso from thresholds",
    "ledger", thresholds=_THRESHOLDS)

_CYCLE_TEXT = """array_to_string(ciclo, ',') as ciclo, num_saltos,
       array_to_string([printf('%.2f', cast(x as double)) for x in legs], ',') as montos"""
_SQL["g1_money_cycles"] = with_tables(f"""
select {_CYCLE_TEXT}, cast(mn as double) as monto_minimo_tramo,
       round(cast(mx as double) / cast(mn as double), 3) as ratio_monto from cycles""",
    "ledger", thresholds=_THRESHOLDS, **_cycles("(select ciclo from thresholds)"))

_CHOSEN = """
select rfc, num_saltos, ciclo, legs from (
  select rfc, num_saltos, ciclo, legs,
         row_number() over (partition by rfc order by num_saltos, ciclo) as k
  from (select unnest(ciclo) as rfc, * from cycles)) where k = 1"""
_SQL["g2_cycle_of"] = with_tables(
    f"select rfc, {_CYCLE_TEXT} from chosen where rfc in (select rfc from entities)",
    "entities ledger", **_cycles("1"), chosen=_CHOSEN)

# --- materiality ----------------------------------------------------------------------------------

_SQL["m1_folded_text"] = f"""
select doc_id, md5(t) as texto, length(t) as largo
from (select doc_id, {_FOLD.format('text')} as t from documents)"""
_BOOKS4 = "entities invoices items catalog"
_SQL["m2a_issued_descriptions"] = with_tables(
    "select * from issued", "invoices items", issued=_ISSUED)
_SQL["m2b_profiles"] = with_tables("select * from heads", _BOOKS4, **_MATERIALITY)
_SQL["m2c_profile_words"] = with_tables("select * from words", _BOOKS4, **_MATERIALITY)
_SQL["m3_concept_verdicts"] = with_tables("""
select j.rfc, j.concepto, case when conocido then corresponde end as corresponde, generico, match,
       case when not conocido then j.rfc ||
                ' no tiene giro declarado ni facturas emitidas con las que contrastar el concepto.'
            when corresponde then 'El concepto corresponde al giro (' || giro || ').'
            when not generico then 'El concepto (''' || j.concepto || ''') es ajeno al giro de '
                || razon_social || ' (' || giro || '), pero es un servicio específico.'
            else 'El concepto (''' || j.concepto || ''') es genérico y ajeno al giro de '
                || razon_social || ' (' || giro || ': ' || muestra || ').' end as motivo
from judged j left join sample s on s.rfc = j.rfc""", _BOOKS4, **_MATERIALITY, sample="""
select rfc, string_agg(descripcion, ', ' order by descripcion) as muestra from (
  select *, row_number() over (partition by rfc order by descripcion) as k from descriptions)
where k <= 3 group by rfc""")
_SQL["m4_invoice_verdicts"] = with_tables("""
select i.uuid, receptor_rfc as rfc, match, concepto from invoices i left join (
  select r.uuid, r.concepto, j.match,
         row_number() over (partition by r.uuid
             order by coalesce(j.match, true), r.fila, r.concepto) as k
  from received r join judged j on j.rfc = r.rfc and j.concepto = r.concepto) v
on v.uuid = i.uuid and v.k = 1""", _BOOKS4, **_MATERIALITY)

# --- detectors -------------------------------------------------------------------------------------

_D = {
    "d1": """select distinct receptor_rfc as rfc from invoices join blacklist b
on b.rfc = emisor_rfc where situacion in ('PRESUNTO', 'DEFINITIVO')""",
    "d2": """select emisor_rfc as rfc from bank where abs(discrepancia) > 1
and (select count(*) from ledger) > 0
union select receptor_rfc from bank where abs(discrepancia) > 1
and (select count(*) from ledger) > 0""",
    "d4": """select distinct receptor_rfc as rfc from invoices join items on invoice_uuid = uuid
where lower(descripcion) like '%economy hot%' or lower(descripcion) like '%promo old%'""",
    "d5": """select distinct cuenta_destino_rfc as rfc from ledger where cfdi_uuid is null
and monto >= (select ingreso from thresholds)""",
}
_SQL["d1_bought_from_listed"] = with_tables(_D["d1"], "invoices blacklist")
_SQL["d2_unmatched_payments"] = with_tables(_D["d2"], "invoices ledger", bank=_BANK)
_SQL["d3_cycle_members"] = with_tables(
    "select rfc from members", "ledger", thresholds=_THRESHOLDS,
    **_cycles("(select ciclo from thresholds)"))
_SQL["d4_vague_concepts"] = with_tables(_D["d4"], "invoices items")
_SQL["d5_undeclared_income"] = with_tables(_D["d5"], "ledger", thresholds=_THRESHOLDS)

_CANDIDATES = "select rfc, string_agg(d, ',' order by d) as detectores from (" + " union ".join(
    f"select rfc, '{name.upper()}' as d from ({text})" for name, text in
    {**_D, "d3": "select distinct rfc from big_members"}.items()) + ") group by rfc"
_BIG = {
    "big_cycles": "select * from cycles where mn >= (select ciclo from thresholds)",
    "big_members": "select distinct unnest(ciclo) as rfc from big_cycles",
}
_SQL["d6_candidates"] = with_tables(
    "select * from candidates", "blacklist invoices items ledger", thresholds=_THRESHOLDS,
    **_cycles("(select ciclo from thresholds)"), bank=_BANK,
    **_BIG, candidates=_CANDIDATES)

# --- evidence and verdicts ---------------------------------------------------------------------------

_SQL["e1_resolved_evidence"] = with_tables(
    "select * replace (cast(monto as double) as monto) from resolved",
    "invoices ledger evidence", **_resolved())
_SQL["e2_evidence_totals"] = with_tables("""
select lead_id, cast(coalesce(sum(case when contado_en_total then monto end), 0) as double)
       as monto_total_evidencia from resolved group by lead_id""",
    "invoices ledger evidence", **_resolved())
_SQL["e3_verdicts"] = _draft_case("""
select lead_id, rfc_imputado, razon_social, tipo_esquema,
       cast(monto_total_evidencia as double) as monto_total_evidencia, confirmado,
       estatus_dictamen, regla_fallida, razon from verdicts""")
_SQL["e4_proof_69b"] = _draft_case("select distinct lead_id from marked where prueba_69b")
_SQL["e5_proof_cycle"] = with_tables(
    "select rfc from entities where rfc in (select rfc from members)", "entities ledger",
    **_cycles("1"))
_SQL["e6_proof_materiality"] = _draft_case(
    "select distinct lead_id from marked where prueba_materialidad")
_SQL["e7_proof_income"] = with_tables("""
select distinct e.lead_id from (
  select lead_id, rfc_imputado, tx_id from evidence
  where tipo = 'transferencia' or (tipo is null and coalesce(uuid, '') = '')
  union all select tx_id, cuenta_destino_rfc, tx_id from ledger
  union all select 'de:' || tx_id, cuenta_origen_rfc, tx_id from ledger) e
join ledger l on l.tx_id = e.tx_id
where l.cfdi_uuid is null and l.cuenta_destino_rfc = e.rfc_imputado
  and l.monto >= (select ingreso from thresholds)""", "ledger evidence", thresholds=_THRESHOLDS)

_AUDITED = "select rfc from entities where es_empresa_auditada"
_SQL["e8a_dossier"] = with_tables("""
select a.rfc, i.uuid, emisor_rfc, receptor_rfc, cast(total as double) as total, tx_id,
       cast(monto as double) as monto
from audited a join invoices i on i.emisor_rfc = a.rfc or i.receptor_rfc = a.rfc
left join ledger l on l.cfdi_uuid = i.uuid""", "entities invoices ledger", audited=_AUDITED)
_SQL["e8b_suppliers_with_status"] = with_tables("""
select comprador, s.rfc, situacion, cast(publicacion_dof as varchar) as publicacion_dof,
       cast(coalesce(monto_presunto_total, 0) as double) as monto_presunto_total,
       b.rfc is not null as en_lista_69b
from (select distinct receptor_rfc as comprador, emisor_rfc as rfc from invoices
      where receptor_rfc in (select rfc from audited)) s
left join blacklist b on b.rfc = s.rfc""", "entities invoices blacklist", audited=_AUDITED)
_SQL["e8c_income_without_invoice"] = with_tables("""
select cuenta_destino_rfc as rfc, count(*) as n, cast(sum(monto) as double) as total,
       cast(max(monto) as double) as mayor from ledger where cfdi_uuid is null group by 1""",
    "ledger")
_SQL["e8d_counterparty_ledger"] = with_tables("""
select a.rfc, tx_id, cuenta_origen_rfc, cuenta_destino_rfc, cast(monto as double) as monto
from audited a join ledger l on l.cuenta_origen_rfc = a.rfc or l.cuenta_destino_rfc = a.rfc""",
    "entities ledger", audited=_AUDITED)
_SQL["e8e_ranked_cases"] = _draft_case("""
select rfc_imputado, tipo_esquema, cast(monto_total_evidencia as double) as monto_total_evidencia
from verdicts where confirmado order by 3 desc, 1""")
_SQL["e8e_cases_by_scheme"] = _draft_case("""
select tipo_esquema, count(*) as n, cast(max(monto_total_evidencia) as double) as mayor,
       cast(min(monto_total_evidencia) as double) as menor
from verdicts where confirmado group by 1""")

_PROPOSED = {
    "bank": _BANK,
    **_BIG,
    "candidates": _CANDIDATES,
    "chosen": _CHOSEN.replace("from cycles", "from big_cycles"),
    "legs": """
select rfc, ciclo[k] as origen, ciclo[k % num_saltos + 1] as destino
from (select rfc, ciclo, num_saltos, unnest(range(1, num_saltos + 1)) as k from chosen)""",
    "proving": """
select receptor_rfc as rfc, 1 as prioridad, 'factura' as tipo, uuid, cast(null as varchar) as tx_id
from invoices join blacklist b on b.rfc = emisor_rfc and situacion = 'DEFINITIVO'
union all
select g.rfc, 2, 'transferencia', null, tx_id from legs g join ledger
on cuenta_origen_rfc = origen and cuenta_destino_rfc = destino
where g.rfc in (origen, destino)
union all
select cuenta_destino_rfc, 3, 'transferencia', null, tx_id from ledger
where cfdi_uuid is null and monto >= (select ingreso from thresholds)
union all
select rfc, case when rfc in (select emisor_rfc from invoices) then 5 else 4 end, 'factura', uuid,
       null from immaterial""",
    "strongest": "select rfc, min(prioridad) as prioridad from proving group by rfc",
    "p1_leads": """
select c.rfc as lead_id, c.rfc as rfc_imputado,
       case prioridad when 1 then 'EFOS_69B' when 2 then 'KICKBACK_CIRCULAR'
            when 3 then 'INGRESO_NO_DECLARADO' when 4 then 'EMPRESA_FACHADA'
            when 5 then 'SIN_MATERIALIDAD' else '' end as tipo_esquema
from candidates c left join strongest s on s.rfc = c.rfc""",
    "p1_evidence": """
select p.rfc as lead_id, p.rfc as rfc_imputado, 0 as pos, tipo, uuid, tx_id
from proving p join strongest s on s.rfc = p.rfc and s.prioridad = p.prioridad
where p.rfc in (select rfc from candidates)""",
}


def _batch(select: str, **more) -> str:
    return with_tables(
        select, "entities blacklist invoices items ledger catalog", thresholds=_THRESHOLDS,
        **_cycles("1"), **_MATERIALITY, **_PROPOSED, **_resolved("p1_evidence"), **_MARKED,
        **_decided("p1_leads"), **more)


_SQL["e9_proposed_leads"] = _batch("select rfc_imputado, tipo_esquema from p1_leads")
_SQL["e9_proposed_evidence"] = _batch(
    "select rfc_imputado, tipo, id, contado_en_total from resolved")
_SQL["p1_batch_verdicts"] = _batch("""
select rfc_imputado, razon_social, tipo_esquema,
       cast(monto_total_evidencia as double) as monto_total_evidencia, estatus_dictamen,
       regla_fallida from verdicts""")

_SEEN = {"seen": "select uuid as id from invoices union select tx_id from ledger",
         "named": """
select *, case when uuid <> '' then uuid else tx_id end as id,
       case when uuid <> '' then uuid else tx_id end in (select id from seen) as visto
from evidence"""}
_SQL["e10_unseen_dropped_leads"] = with_tables("""
select l.lead_id, rfc_imputado, case when e.lead_id is not null then 'SIN_MATERIALIDAD'
       else tipo_esquema end as tipo_esquema
from leads l left join (select lead_id from named group by 1 having not bool_or(visto)) e
on e.lead_id = l.lead_id""", "invoices ledger leads evidence", **_SEEN)
_SQL["e10_unseen_dropped_evidence"] = with_tables("""
select lead_id, rfc_imputado, pos, tipo, uuid, tx_id from named where visto""",
    "invoices ledger evidence", **_SEEN)

# --- case output ------------------------------------------------------------------------------------

_NUMBERED = {
    "yes": """select *, row_number() over (order by rfc_imputado, lead_id) as numero
from verdicts where confirmado""",
    "no": """select *, row_number() over (order by rfc_imputado, lead_id) as numero
from verdicts where not confirmado""",
}


def _fixed(part: int, texts: list[str]) -> str:
    return " union all ".join(
        f"select {part} as parte, 0 as numero, {i} as linea, 0 as pos, '' as id, {t} as texto"
        for i, t in enumerate(texts))


def _section(part: int, table: str, lines: dict[int, str]) -> str:
    return " union all ".join(
        f"select {part}, numero, {n}, 0, '', {t} from {table}" for n, t in lines.items())


_COUNT = "cast((select count(*) from {}) as varchar)"
_TOTAL = _money("monto_total_evidencia")
_ROW_AMOUNT = f"coalesce({_money('monto')}, '—')"
_NAME = "case when razon_social <> '' then razon_social else 's/n' end"
_STORY = "'Orden ' || substr(lead_id, 2)"
_SCHEME = "case when tipo_esquema <> '' then tipo_esquema else 'sin tipificar' end"
_DOCUMENT = " union all ".join([
    _fixed(0, ["'# Expediente Forense de Fraude Fiscal'", "''",
               "'_Generado el 2024-01-01 00:00._'", "''",
               "'> Redactado con plantilla determinista a partir de los registros verificados.'",
               "''", f"'**Casos confirmados con prueba:** ' || {_COUNT.format('yes')} || '  '",
               f"'**Leads descartados por falta de evidencia:** ' || {_COUNT.format('no')}",
               "''", "'---'", "''", "'## Casos confirmados'", "''"]),
    _section(1, "yes", {
        0: f"'### ' || cast(numero as varchar) || '. ' || rfc_imputado || ' — ' || {_NAME}",
        1: "''", 2: "'- **Tipología:** ' || tipo_esquema",
        3: f"'- **Monto total acreditado:** ' || {_TOTAL}",
        4: "'- **Regla fiscal violada:** Artículo 69-B del CFF'", 5: "''", 6: _STORY, 7: "''",
        8: "'**Cadena de evidencia**'", 9: "''",
        10: "'| Tipo | Identificador | Monto | Suma al total |'", 11: "'|---|---|---|---|'",
        101: "''"}),
    f"""select 1, numero, 100, pos, id, '| ' || tipo || ' | `' || id || '` | ' || {_ROW_AMOUNT}
        || ' | ' || case when contado_en_total then 'sí' else 'no (respaldo)' end || ' |'
        from resolved join yes using (lead_id)""",
    _fixed(2, ["'---'", "''", "'## Leads descartados'", "''"]),
    _section(3, "no", {0: f"'- **' || rfc_imputado || '** (tentativa: ' || {_SCHEME} || ') — ' "
                          "|| razon"}),
    _fixed(4, ["''"])])
_SQL["r1_case_document"] = _draft_case("select * from document", **_NUMBERED, document=_DOCUMENT)
_SQL["r1_numbered_cases"] = with_tables("""
select lead_id, rfc_imputado, row_number() over (order by rfc_imputado, lead_id) as numero
from leads""", "leads")
_SQL["r2_case_context"] = _draft_case(" union all ".join([
    _fixed(0, ["'=== CASOS CONFIRMADOS ==='"]),
    _section(1, "yes", {
        0: "''", 1: f"'RFC ' || rfc_imputado || ' — ' || {_NAME}",
        2: "'  esquema: ' || tipo_esquema", 3: f"'  monto acreditado: ' || {_TOTAL} || ' MXN'",
        4: "'  regla violada: Artículo 69-B del CFF'", 5: f"'  hechos: ' || {_STORY}"}),
    f"""select 1, numero, 100, pos, id, '    - ' || tipo || ' ' || id || ' por ' || {_ROW_AMOUNT}
        || case when de_rfc is not null then ', de ' || de_rfc || ' a ' || a_rfc else '' end
        || case when contado_en_total then ' (suma al total)' else ' (respaldo, no suma)' end
        from resolved join yes using (lead_id)""",
    _fixed(2, ["''", "'=== LEADS DESCARTADOS (revisados y NO imputados) ==='"]),
    _section(3, "no", {
        0: f"'  - RFC ' || rfc_imputado || ' (tentativa: ' || {_SCHEME} || ')'",
        1: "'    razón del descarte: ' || razon"})]), **_NUMBERED)
_SQL["r3_run_summary"] = _draft_case("""
select count(*) filter (confirmado) as n_confirmados,
       count(*) filter (not confirmado) as n_descartados,
       cast(coalesce(sum(monto_total_evidencia) filter (confirmado), 0) as double)
           as monto_acreditado from verdicts""")

_EDGES = {
    "cited_edges": f"""
select lead_id, 0 as grupo, pos, id, de_rfc, a_rfc,
       case when tipo = 'factura' then 'CFDI  ' else 'transferencia  ' end || {_money('monto')}
           as etiqueta, false as es_ciclo
from resolved where existe and lead_id in (select lead_id from verdicts where confirmado)""",
    "proof_chosen": _CHOSEN,
    "edges": f"""
select * from cited_edges union all
select lead_id, 1, k - 1, '', origen, destino, {_money('monto')}, true
from (select v.lead_id, k, ciclo[k] as origen, ciclo[k % num_saltos + 1] as destino,
             legs[k] as monto
      from (select *, unnest(range(1, num_saltos + 1)) as k from proof_chosen) c
      join verdicts v on v.rfc_imputado = c.rfc and v.confirmado
      where v.tipo_esquema = 'KICKBACK_CIRCULAR') g
where not exists (select 1 from cited_edges e where e.lead_id = g.lead_id
                  and e.de_rfc = g.origen and e.a_rfc = g.destino)""",
    "nodes": """
select m.lead_id, m.rfc, case when v.rfc_imputado = m.rfc then 'IMPUTADO'
       when b.rfc is not null then 'LISTADO' else 'OTRO' end as papel,
       case when v.rfc_imputado = m.rfc then v.razon_social else '' end as razon_social
from (select lead_id, de_rfc as rfc from edges union select lead_id, a_rfc from edges
      union select lead_id, rfc_imputado from verdicts where lead_id in
      (select lead_id from edges)) m
join verdicts v on v.lead_id = m.lead_id
left join blacklist b on b.rfc = m.rfc and b.situacion = 'DEFINITIVO'""",
}
_SQL["r4_trail_edges"] = _batch("select * from edges", **_EDGES)
_SQL["r4_trail_nodes"] = _batch("select * from nodes", **_EDGES)


def _quote(column: str) -> str:
    return f"replace({column}, '\"', '\\\"')"


_BOX = "'  \"' || {rfc} || '\" [label=\"' || {label} || '\" fillcolor=\"{fill}\" " \
       "fontcolor=\"{ink}\"];'"
_NODE = _quote("rfc")
_SQL["r5_trail_text"] = _batch(f"""
select lead_id, 0 as parte, 0 as grupo, pos, '' as id, texto
from (select distinct lead_id from edges), (values
  (0, 'digraph rastro {{'), (1, '  rankdir=LR; bgcolor="transparent";'),
  (2, '  node [shape=box style="rounded,filled" fontname="Helvetica" fontsize=10 penwidth=0 '
      || 'margin="0.18,0.10"];'),
  (3, '  edge [fontname="Helvetica" fontsize=9 color="#94A3B8" penwidth=1.3];')) h(pos, texto)
union all select distinct lead_id, 3, 0, 0, '', '}}' from edges
union all select lead_id, 1, 0, 0, rfc, case papel
  when 'IMPUTADO' then {_BOX.format(rfc=_NODE, label="case when razon_social <> '' then " + _NODE
                                    + " || '\\n' || " + _quote('razon_social') + " else " + _NODE
                                    + " end", fill=fv.COLOR_ACCUSED, ink="white")}
  when 'LISTADO' then {_BOX.format(rfc=_NODE, label=_NODE + " || '\\n69-B DEFINITIVO'",
                                   fill=fv.COLOR_LISTED, ink="white")}
  else {_BOX.format(rfc=_NODE, label=_NODE, fill=fv.COLOR_OTHER, ink=fv.COLOR_OTHER_TEXT)} end
from nodes
union all select lead_id, 2, grupo, pos, id,
  '  "' || de_rfc || '" -> "' || a_rfc || '" [label="  ' || etiqueta || '" ' || case when es_ciclo
  then 'color="{fv.COLOR_ACCUSED}" penwidth=2.0' else 'color="{fv.COLOR_EDGE}"' end || '];'
from edges""", **_EDGES)
_SQL["r6_legends"] = with_tables(
    "select lead_id, case tipo_esquema " + " ".join(
        f"when '{k}' then '{v}'" for k, v in fv.LEGENDS.items())
    + f" else '{fv.LEGEND_DEFAULT}' end as leyenda from leads", "leads")
_SQL["r7_evidence_rows"] = with_tables(f"""
select lead_id, pos, tipo as instrumento, id as identificador, coalesce(de_rfc, '—') as de,
       coalesce(a_rfc, '—') as a, {_ROW_AMOUNT} as monto,
       case when contado_en_total then 'Suma al total' else 'Respaldo (no suma)' end as computo
from resolved""", "invoices ledger evidence", **_resolved())
_SQL["r8_case_summary"] = _draft_case(f"""
select numero, rfc_imputado as rfc, razon_social as nombre, tipo_esquema as esquema,
       {_TOTAL} as monto from yes
union all select null, 'TOTAL', '', '', {_money('coalesce(sum(monto_total_evidencia), 0)')}
from yes""", **_NUMBERED)

# --- audits ---------------------------------------------------------------------------------------------

_CUS, _SUP = customer_id("o_custkey"), supplier_id("o_orderkey")
_AMOUNT = f"format('{{:,.2f}}', cast({money('o_totalprice')} as double))"
_ANSWERS = f"""
select 'O' || cast(o_orderkey as varchar) as answer_id,
       case o_orderpriority
         when '1-URGENT' then 'No se imputo a ' || {_CUS} || ' por falta de pruebas. '
         when '2-HIGH' then 'No hay leads descartados; el expediente imputo a ' || {_CUS} || '. '
         when '3-MEDIUM' then 'Fue exonerada ' || lower({_CUS}) || ' en la revision. '
         else 'El monto de ' || {_CUS} || ' es $' || {_AMOUNT} || ' MXN. ' end
       || case o_orderstatus
         when 'F' then 'El proveedor ' || {_SUP} || ' es solo presunto. '
         when 'O' then 'El proveedor ' || {_SUP} || ' esta en situacion DEFINITIVO. '
         else '' end
       || 'Folio ' || {folio('O', 'o_orderkey')} as text,
       case when o_orderstatus <> 'P' then 'Que paso con ' || {_CUS} || '?' end as question
from orders
union all
select 'D' || cast(doc_id as varchar),
       text || ' No acuse a ' || {customer_id('doc_id')} || ', ' || text, null
from documents"""
_CITED = f"""
select distinct answer_id, unnest(list_concat(
       regexp_extract_all(text, '{fv.UUID_PATTERN}'),
       regexp_extract_all(text, '{fv.TAXID_PATTERN}'))) as id from answers"""
_SQL["a1_cited_identifiers"] = f"with answers as ({_ANSWERS}) " + _CITED
_SQL["a2_invented_identifiers"] = f"""
with answers as ({_ANSWERS}), cited as ({_CITED}), asked as (
  select answer_id, unnest(regexp_extract_all(question, '{fv.TAXID_PATTERN}')) as id
  from answers where question is not null)
select answer_id, id from cited c
where not exists (select 1 from asked a where a.answer_id = c.answer_id and a.id = c.id)
  and not exists (select 1 from orders where o_orderpriority <> '5-LOW'
                  and 'O' || cast(o_orderkey as varchar) = c.answer_id
                  and {folio('O', 'o_orderkey')} = c.id)"""
_BUYERS = {"buyers": """
select receptor_rfc as rfc, total from invoices
join blacklist b on b.rfc = emisor_rfc where situacion = 'DEFINITIVO'"""}
# By construction of the answers, which sentence denies an ID is known.
_SQL["a3_denied_cases"] = with_tables(f"""
select answer_id, rfc from (
  select 'O' || cast(o_orderkey as varchar) as answer_id, {_CUS} as rfc from orders
  where o_orderpriority in ('1-URGENT', '3-MEDIUM')
  union all select 'D' || cast(doc_id as varchar), {customer_id('doc_id')} from documents)
where rfc in (select rfc from buyers)""", "invoices blacklist", **_BUYERS)
_SQL["a4_wrong_list_status"] = with_tables(f"""
select 'O' || cast(o_orderkey as varchar) as answer_id, b.rfc, situacion
from orders join blacklist b on b.rfc = {_SUP}
where (o_orderstatus = 'F' and situacion = 'DEFINITIVO')
   or (o_orderstatus = 'O' and situacion = 'PRESUNTO')""", "blacklist")
# An order's answer names two IDs and one amount twice, all within reach of each other.
_SQL["a5_swapped_amounts"] = with_tables("""
select s.answer_id, s.rfc, cast(s.monto as double) as monto, a.dueno, a.n_duenos
from said s join (select monto, min(rfc) as dueno, count(*) as n_duenos from amounts
                  group by monto) a on a.monto = s.monto
where s.rfc in (select rfc from amounts)
  and not exists (select 1 from amounts o where o.rfc = s.rfc and o.monto = s.monto)""",
    "invoices blacklist", **_BUYERS, amounts="""
select rfc, cast(sum(total) as decimal(24,2)) as monto from buyers group by rfc
union select rfc, cast(total as decimal(24,2)) from buyers""",
    first="select rfc, max(monto) as monto from amounts group by rfc", said=f"""
select 'O' || cast(o_orderkey as varchar) as answer_id, {customer_id('o_orderkey')} as rfc, monto
from orders join first on rfc = {_CUS}
union all
select distinct 'I' || receptor_rfc || '/' || cast(total as varchar), receptor_rfc,
       cast(total as decimal(24,2)) from invoices""")
# By construction, the order's answer and the document's name one customer each.
_SQL["a3_denied_odd_ids"] = """
select 'O' || cast(o_orderkey as varchar) as answer_id, upper(c_name) as rfc
from orders join customer on c_custkey = o_custkey
where c_acctbal > 0 and o_orderpriority in ('1-URGENT', '3-MEDIUM')
union all
select 'D' || cast(doc_id as varchar), upper(c_name)
from documents join customer on c_name = 'Customer#' || lpad(cast(doc_id % 2000 as varchar), 9, '0')
where c_acctbal > 0"""
_SQL["a5_swapped_odd_ids"] = f"""
with amounts as (
  select c_name as rfc, max(cast({money('o_totalprice')} as decimal(24,2))) as monto
  from orders join customer on c_custkey = o_custkey group by c_name),
owners as (select monto, min(rfc) as dueno, count(*) as n_duenos from amounts group by monto),
said as (
  select 'R' || c_name as answer_id, c_name as rfc, a.monto from customer
  join amounts a on a.rfc = 'Customer#' || lpad(cast(c_custkey + 7 as varchar), 9, '0')
  union all
  select 'O' || cast(o_orderkey as varchar), c_name,
         cast({money('o_totalprice')} as decimal(24,2))
  from orders join customer on c_custkey = o_custkey
  where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM'))
select s.answer_id, s.rfc, cast(s.monto as double) as monto, o.dueno, o.n_duenos
from said s join owners o on o.monto = s.monto join amounts a on a.rfc = s.rfc
where a.monto <> s.monto"""
_SQL["a6_report_reconciliation"] = _draft_case(f"""
select 'MONTO' as clase, valor, cast(replace(valor, ',', '') as decimal(24,2)) in (
         select cast(total as decimal(24,2)) from invoices union all
         select cast(monto as decimal(24,2)) from ledger union all
         select cast(monto_total_evidencia as decimal(24,2)) from yes) as existe
from (select distinct unnest(regexp_extract_all(texto, '{fv.MONEY_PATTERN}', 1)) as valor
      from document)
union all
select case when regexp_full_match(valor, '{fv.UUID_PATTERN}') then 'FOLIO' else 'RFC' end, valor,
       valor in (select uuid from invoices union all select tx_id from ledger
                 union all select rfc from entities)
from (select distinct unnest(list_concat(regexp_extract_all(texto, '{fv.UUID_PATTERN}'),
             regexp_extract_all(texto, '{fv.TAXID_PATTERN}'))) as valor from document)""",
    **_NUMBERED, document=_DOCUMENT)
_SQL["q1_guarded_sql"] = with_tables("""
select receptor_rfc as rfc, count(*) as n, cast(sum(discrepancia) as double) as falta
from bank where abs(discrepancia) > 1 and receptor_rfc in (select rfc from entities)
group by 1""", "entities invoices ledger", bank=_BANK)
