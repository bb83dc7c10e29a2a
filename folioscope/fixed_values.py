"""The vocabularies, patterns and labels every result depends on.

They are given by the domain (tax authority codes, invoice labels) or by the
output formats, so they are stated here once, as plain text, and passed around
as defaults. Nothing in this module computes anything.
"""

# --- Fixed values: enumerations -------------------------------------------
STATUS_PRESUMED = "PRESUNTO"
STATUS_CLEARED = "DESVIRTUADO"
STATUS_FINAL = "DEFINITIVO"
LIST_STATUSES = ("PRESUNTO", "DESVIRTUADO", "DEFINITIVO")
PAYMENT_METHODS = ("PUE", "PPD")
INVOICE_STATES = ("VIGENTE", "CANCELADO")
SCHEMES = (
    "EFOS_69B",
    "KICKBACK_CIRCULAR",
    "INGRESO_NO_DECLARADO",
    "EMPRESA_FACHADA",
    "SIN_MATERIALIDAD",
)  # strict priority, strongest first
CONFIRMED = "CONFIRMADO_CON_PRUEBA"
REJECTED = "DESCARTADO_FALTA_EVIDENCIA"
AUTHOR_KINDS = ("gemini", "plantilla")
INVOICE_KIND = "factura"
TRANSFER_KIND = "transferencia"

# --- Fixed values: table names and columns of the input --------------------
REQUIRED_TABLES = ("Entidades", "Lista_69B", "Facturas", "Partidas", "Transacciones_Bancarias")

REQUIRED_COLUMNS = {
    "Entidades": ("rfc", "razon_social", "fecha_constitucion", "representante_legal",
                  "codigo_postal", "es_empresa_auditada"),
    "Lista_69B": ("rfc", "situacion", "publicacion_dof", "monto_presunto_total"),
    "Facturas": ("uuid", "emisor_rfc", "receptor_rfc", "fecha_emision", "subtotal", "total",
                 "metodo_pago", "forma_pago", "estado_cfdi"),
    "Partidas": ("invoice_uuid", "clave_prod_serv", "descripcion", "cantidad",
                 "valor_unitario", "importe"),
    "Transacciones_Bancarias": ("tx_id", "cuenta_origen_rfc", "cuenta_destino_rfc", "fecha_hora",
                                "monto", "referencia_bancaria", "cfdi_uuid"),
}

NOT_NULL_COLUMNS = {
    "Entidades": ("rfc", "razon_social", "codigo_postal"),
    "Lista_69B": ("rfc", "situacion", "publicacion_dof"),
    "Facturas": ("uuid", "emisor_rfc", "receptor_rfc", "fecha_emision", "subtotal", "total",
                 "forma_pago"),
    "Partidas": ("invoice_uuid", "clave_prod_serv", "descripcion", "cantidad",
                 "valor_unitario", "importe"),
    "Transacciones_Bancarias": ("tx_id", "cuenta_origen_rfc", "cuenta_destino_rfc",
                                "fecha_hora", "monto"),
}

# --- Fixed values: names a foreign file may use (already normalised) -------
COLUMN_SYNONYMS = {
    "Entidades": {
        "rfc": ("rfc", "rfccontribuyente", "rfcempresa", "registrofederaldecontribuyentes"),
        "razon_social": ("razonsocial", "nombre", "nombrecontribuyente", "empresa",
                         "denominacionsocial"),
        "fecha_constitucion": ("fechaconstitucion", "fechadeconstitucion", "fechadealta",
                               "fechadeconstitucionempresa", "constitucion"),
        "representante_legal": ("representantelegal", "representante", "apoderado"),
        "codigo_postal": ("codigopostal", "cp", "codpostal"),
        "es_empresa_auditada": ("esempresaauditada", "auditada", "enauditoria"),
    },
    "Lista_69B": {
        "rfc": ("rfc", "rfccontribuyente", "rfcefos"),
        "situacion": ("situacion", "situacioncontribuyente", "estatus", "estado"),
        "publicacion_dof": ("publicaciondof", "fechadof", "fechapublicacion",
                            "fechadepublicacion", "publicacion"),
        "monto_presunto_total": ("montopresuntototal", "montopresunto", "monto"),
    },
    "Facturas": {
        "uuid": ("uuid", "folilofiscal", "foliofiscal", "uuidcfdi", "iduuid", "cfdiuuid"),
        "emisor_rfc": ("emisorrfc", "rfcemisor", "rfcdelemisor", "emisor", "rfcproveedor"),
        "receptor_rfc": ("receptorrfc", "rfcreceptor", "rfcdelreceptor", "receptor",
                         "rfccliente"),
        "fecha_emision": ("fechaemision", "fechadeemision", "fecha", "fechafactura",
                          "fechadefactura"),
        "subtotal": ("subtotal", "importeneto", "baseimponible"),
        "total": ("total", "montototal", "importetotal", "grantotal", "importe"),
        "metodo_pago": ("metodopago", "metododepago", "metodo"),
        "forma_pago": ("formapago", "formadepago", "forma"),
        "estado_cfdi": ("estadocfdi", "estatuscfdi", "estadofactura", "vigencia"),
    },
    "Partidas": {
        "invoice_uuid": ("invoiceuuid", "uuidfactura", "uuid", "foliofiscal", "cfdiuuid"),
        "clave_prod_serv": ("claveprodserv", "claveproductoservicio", "clavesat",
                            "clavedeproductooservicio", "clave"),
        "descripcion": ("descripcion", "concepto", "detalle", "descripcionconcepto"),
        "cantidad": ("cantidad", "qty", "unidades"),
        "valor_unitario": ("valorunitario", "preciounitario", "preciodeunidad", "precio"),
        "importe": ("importe", "importepartida", "subtotalpartida", "total"),
    },
    "Transacciones_Bancarias": {
        "tx_id": ("txid", "idtransaccion", "idmovimiento", "foliomovimiento"),
        "cuenta_origen_rfc": ("cuentaorigenrfc", "rfcorigen", "origen", "rfcordenante",
                              "ordenante"),
        "cuenta_destino_rfc": ("cuentadestinorfc", "rfcdestino", "destino", "rfcbeneficiario",
                               "beneficiario"),
        "fecha_hora": ("fechahora", "fecha", "fechamovimiento", "fechaoperacion",
                       "fechadeoperacion", "fechadelmovimiento"),
        "monto": ("monto", "importe", "cantidad", "montotransferido"),
        "referencia_bancaria": ("referenciabancaria", "referencia", "concepto", "descripcion"),
        "cfdi_uuid": ("cfdiuuid", "uuidcfdi", "uuidfactura", "foliofiscal"),
    },
}

TABLE_SYNONYMS = {
    "Entidades": ("entidades", "empresas", "contribuyentes", "padron", "catalogoempresas",
                  "clientes", "proveedores"),
    "Lista_69B": ("lista69b", "69b", "listanegra", "efos", "blacklist", "listasat",
                  "articulo69b"),
    "Facturas": ("facturas", "cfdi", "comprobantes", "ventas", "facturacion", "ingresos",
                 "cfdis"),
    "Partidas": ("partidas", "conceptos", "detalle", "items", "lineas", "detallefactura",
                 "conceptosfactura"),
    "Transacciones_Bancarias": ("transaccionesbancarias", "transacciones", "bancos",
                                "movimientos", "estadodecuenta", "transferencias", "spei",
                                "movimientosbancarios", "pagos"),
}

# --- Fixed values: accepted spellings while parsing -------------------------
TRUE_WORDS = ("TRUE", "1", "SI", "SÍ", "YES")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
                "dd/MM/yyyy", "dd-MM-yyyy")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                     "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
                     "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")

# --- Fixed values: official list layout (position of each field) ------------
OFFICIAL_LISTS = (
    # (order, status text in the file, canonical status, position of the date)
    (1, "Definitivo", "DEFINITIVO", 15),
    (2, "Presunto", "PRESUNTO", 7),
)
OFFICIAL_DATE_FORMAT = "dd/MM/yyyy"
OFFICIAL_RECENT_YEAR = 2024
OFFICIAL_PREAMBLE_ROWS = 3

# --- Fixed values: tax ID arithmetic -----------------------------------------
TAXID_ALPHABET = "0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZ Ñ"
TAXID_MODULUS = 11

# --- Fixed values: patterns ---------------------------------------------------
UUID_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TAXID_SHAPE = r"[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}"
TAXID_PATTERN = r"\b" + TAXID_SHAPE + r"\b"
MONEY_PATTERN = r"(?:\$\s*)?(\d{1,3}(?:,\d{3})*\.\d{2})(?:\s*MXN)?"
ISO_TIMESTAMP_PATTERN = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
SEAL_BLOCK_PATTERN = r"(?s)Cadena Original.*"
STAMPER_PATTERN = r"R\.?\s*F\.?\s*C\.?\s*Proveedor\s*:?\s*(" + TAXID_SHAPE + ")"
INVOICE_TEXT_PATTERNS = {
    "subtotal": r"Subtotal\s*:?\s*([\d,]+\.\d{2})",
    "total": r"(?<![A-Za-z])Total\s*:\s*([\d,]+\.\d{2})",
    "metodo_pago": r"M[ée]todo de pago\s*:?\s*([A-Z]{3})",
    "forma_pago": r"Forma de pago\s*:?\s*(\d{2})",
    "descripcion": r"Descripci[óo]n\s*:\s*([^\n]+)",
    "clave_prod_serv": r"Clave Prod\.?\s*Ser\.?\s*:?\s*(\d{4,8})",
    "cantidad": r"Cantidad\s*:?\s*([\d.]+)",
    "valor_unitario": r"Valor Unitario\s*:?\s*([\d,]+\.\d{2})",
    "importe": r"Importe\s*:?\s*([\d,]+\.\d{2})",
    "cp_emisor": r"Lugar de expedici[óo]n\s*:?\s*(\d{5})",
    "cp_receptor": r"Domicilio Fiscal\s*:?\s*(\d{5})",
}
EMPLOYEE_LINE_PATTERN = r"N[úu]m\. Empleado\s*:?\s*\n?\s*([^\n]+)"
EMPLOYEE_NUMBER_PREFIX = r"^[\d.\-\s]+"
SQL_FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "DETACH",
                 "PRAGMA", "REPLACE", "VACUUM")

# --- Fixed values: defaults for an invoice read from a document ---------------
DOCUMENT_MIN_CHARS = 200
DOCUMENT_DEFAULTS = {
    "codigo_postal": "00000",
    "metodo_pago": "PUE",
    "forma_pago": "99",
    "estado_cfdi": "VIGENTE",
    "clave_prod_serv": "01010101",
    "descripcion": "(sin descripción en el documento)",
}

# --- Fixed values: vocabularies -------------------------------------------------
PROFILE_STOP_WORDS = ("servicios", "servicio", "para", "otros", "general", "generales")
GENERIC_TERMS = ("estrategica", "profesionales diversos", "sin especificar",
                 "apoyo administrativo", "gestion", "servicios diversos")
VAGUE_TERMS = ("consultor", "asesor", "estrat", "profesionales diversos", "sin especificar",
               "servicios diversos")
NEGATIONS = ("no acus", "no se acus", "no imput", "no se imput", "descart", "se descart",
             "no fue acus", "no fue imput", "exoner", "no hay evidencia contra")
SENTENCE_ENDS = "[.;:]"
SAYS_PRESUMED = "presunt"
SAYS_FINAL = "definitiv"
NEGATION_WINDOW = 140
STATUS_WINDOW = 180
MONEY_WINDOW = 120

# --- Fixed values: labels of the case output -------------------------------------
COUNTS_LABEL = "Suma al total"
BACKS_LABEL = "Respaldo (no suma)"
DASH = "—"
LEGENDS = {
    "KICKBACK_CIRCULAR": "En rojo, el ciclo cerrado: el dinero sale y regresa al mismo RFC. "
                         "Ese retorno es lo que distingue el lavado del comercio normal.",
    "EFOS_69B": "En rojo oscuro, el proveedor con situación DEFINITIVO en el listado 69-B del "
                "SAT. Las facturas que le compró son deducciones sobre operaciones simuladas.",
    "INGRESO_NO_DECLARADO": "Depósitos recibidos sin un CFDI que los ampare.",
    "SIN_MATERIALIDAD": "Facturas cuyo concepto no corresponde a un entregable verificable.",
    "EMPRESA_FACHADA": "Operaciones sin sustancia económica detrás.",
}
LEGEND_DEFAULT = "Flujo de dinero acreditado en el expediente."
COLOR_ACCUSED = "#A92D2D"
COLOR_LISTED = "#7A1F1F"
COLOR_OTHER = "#E8EEF5"
COLOR_OTHER_TEXT = "#1F4E79"
COLOR_EDGE = "#6E7A86"

# --- Fixed values: patterns around a draft written as text ---------------------
FENCE_OPENING = r"^```(?:json)?"
FENCE_CLOSING = r"```$"
BRACED = r"(?s)\{.*\}"
