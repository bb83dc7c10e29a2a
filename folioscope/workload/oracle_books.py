"""The books of `books.py` as SQL common table expressions, for the side-by-side check."""

_HEX, _LETTERS = "0123456789abcdef", "ABCDEFGHIJKLMNOP"


def taxid(kind: str, key: str, letters: int) -> str:
    h = f"md5('{kind}:' || cast({key} as varchar))"
    return (f"(translate(substr({h}, 1, {letters}), '{_HEX}', '{_LETTERS}')"
            f" || translate(substr({h}, {letters + 1}, 6), 'abcdef', '012345')"
            f" || upper(substr({h}, {letters + 7}, 3)))")


def supplier_id(key: str) -> str:
    return taxid("S", key, 3)


def customer_id(key: str) -> str:
    return taxid("C", key, 4)


def user_id(key: str) -> str:
    return taxid("U", key, 3)


def folio(kind: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{kind}'"] + [f"cast({p} as varchar)" for p in parts])
    h = f"md5({text})"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4)"
            f" || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))")


def money(name: str) -> str:
    return f"cast({name} as decimal(14,2))"


PAYMENT = folio("P", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                money("l_extendedprice"))
OWN_INVOICE = folio("I", "l_orderkey", "l_suppkey")
_ACCUSED = (f"case when o_totalprice < 30000 then 'XXX010101AAA' else {customer_id('o_custkey')} "
            "end")

BOOKS = {
    "entities": f"""
select {supplier_id('s_suppkey')} as rfc, s_name as razon_social,
       lpad(cast(s_nationkey as varchar), 5, '0') as codigo_postal, false as es_empresa_auditada
from supplier
union all
select {customer_id('c_custkey')}, c_name, lpad(cast(c_nationkey as varchar), 5, '0'),
       c_mktsegment = 'MACHINERY'
from customer
union all
select {user_id('user_id')}, 'Usuario ' || cast(user_id as varchar), '00000', false
from (select distinct user_id from events)""",
    "blacklist": f"""
select {supplier_id('s_suppkey')} as rfc,
       case when s_acctbal < -700 then 'DEFINITIVO' when s_acctbal < 0 then 'PRESUNTO'
            else 'DESVIRTUADO' end as situacion,
       date '2020-01-01' + cast(s_nationkey * 90 as integer) as publicacion_dof,
       abs({money('s_acctbal')}) as monto_presunto_total
from supplier where s_acctbal < 1000""",
    "invoices": f"""
select {OWN_INVOICE} as uuid,
       case when o_orderpriority = '5-LOW' then {customer_id('o_custkey')}
            else {supplier_id('l_suppkey')} end as emisor_rfc,
       case when o_orderpriority = '5-LOW' then {supplier_id('l_suppkey')}
            else {customer_id('o_custkey')} end as receptor_rfc,
       o_orderdate as fecha_emision, total as subtotal, total,
       case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'PUE' else 'PPD' end as metodo_pago,
       case when o_orderpriority = '5-LOW' or o_orderstatus = 'P' then 'CANCELADO'
            else 'VIGENTE' end as estado_cfdi
from (select l_orderkey, l_suppkey,
             cast(sum({money('l_extendedprice')}) as decimal(14,2)) as total
      from lineitem group by l_orderkey, l_suppkey) b
join orders on l_orderkey = o_orderkey""",
    "items": f"""
select {OWN_INVOICE} as invoice_uuid,
       lpad(cast(l_partkey as varchar), 8, '0') as clave_prod_serv,
       p_type || ' ' || p_name as descripcion,
       cast(l_quantity as decimal(10,2)) as cantidad,
       {money('p_retailprice')} as valor_unitario, {money('l_extendedprice')} as importe,
       cast(l_linenumber as bigint) as _row
from lineitem join part on l_partkey = p_partkey""",
    "ledger": f"""
select {PAYMENT} as tx_id, {customer_id('o_custkey')} as cuenta_origen_rfc,
       {supplier_id('l_suppkey')} as cuenta_destino_rfc, l_shipdate as fecha_hora,
       cast({money('l_extendedprice')} - case when l_returnflag = 'R' and l_discount > 0.095
            and l_tax > 0.075 then 5 else 0 end as decimal(14,2)) as monto,
       {OWN_INVOICE} as cfdi_uuid
from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority <> '5-LOW'
union all
select {folio('E', 'event_id')}, {user_id('user_id')},
       {user_id('((user_id * 17 + event_id * 7 + 3) % (select max(user_id) + 1 from events))')},
       ts, cast({money('value')} * 1000 as decimal(14,2)), null
from events where event_type = 'purchase'""",
    "catalog": f"""
select {customer_id('c_custkey')} as rfc, c_name as razon_social, lower(c_mktsegment) as giro,
       case when c_mktsegment = 'BUILDING' then ['Servicios de widget', 'Plate general']
            else ['Gizmo para otros', 'gears'] end as descripciones_esperadas
from customer where c_mktsegment in ('BUILDING', 'MACHINERY')""",
    "leads": f"""
select 'L' || cast(o_orderkey as varchar) as lead_id, {_ACCUSED} as rfc_imputado,
       case when o_orderpriority = '1-URGENT' then 'EFOS_69B'
            when o_orderpriority = '2-HIGH' then 'SIN_MATERIALIDAD'
            when o_orderpriority = '3-MEDIUM' then 'INGRESO_NO_DECLARADO'
            when o_orderpriority = '5-LOW' then 'EMPRESA_FACHADA'
            when o_orderstatus = 'F' then '' when o_orderstatus = 'O' then 'LAVADO'
            else 'KICKBACK_CIRCULAR' end as tipo_esquema
from orders""",
    "evidence": f"""
select 'L' || cast(o_orderkey as varchar) as lead_id, {_ACCUSED} as rfc_imputado,
       cast(l_linenumber as bigint) as pos,
       case when pays or strange then 'transferencia' when l_linestatus = 'F' then 'factura' end
            as tipo,
       case when pays and l_linenumber % 2 = 0 then {OWN_INVOICE}
            when not pays and not strange and l_quantity <> 49 then
            case when l_quantity >= 50 then {folio('X', 'l_orderkey')} else {OWN_INVOICE} end
            end as uuid,
       case when pays or not strange and l_quantity = 49 then {PAYMENT} when strange then {folio('E', 'l_partkey')} end as tx_id
from (select *, l_returnflag = 'R' and l_tax > 0.075 as pays,
             l_returnflag = 'A' and l_discount < 0.005 as strange from lineitem) l
join orders on l_orderkey = o_orderkey""",
}


def with_tables(select: str, tables: str, **more: str) -> str:
    """A query that opens with the named books and further named expressions, in order."""
    parts = [f"{name} as ({BOOKS[name]})" for name in tables.split()]
    parts += [f"{name} as ({text})" for name, text in more.items()]
    recursive = "recursive " if any("paths" in name for name in more) else ""
    return f"with {recursive}" + ",\n".join(parts) + "\n" + select
