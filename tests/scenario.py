"""A small set of books with one seeded fraud of each kind among normal trade."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from folioscope import schema

VICTIM, LISTED = "VIC010101AA1", "EFO010101AA1"
RING = ("ANI010101AA1", "BNI010101AA1", "CNI010101AA1")
TRUCKS, ADVISOR = "TRA010101AA1", "ASE010101AA1"
DEPOSITED = "DEP010101AA1"
NORMAL = tuple(f"NOR{i:06d}AA1" for i in range(20))
VAGUE = "Consultoría estratégica en fusiones y adquisiciones corporativas"


def _money(x) -> Decimal:
    return Decimal(str(round(x, 2))).quantize(Decimal("0.01"))


class Scenario:
    def __init__(self, scale: float = 1.0, frauds: bool = True, bank: bool = True):
        self.scale, self.bank = scale, bank
        self.entities, self.blacklist, self.invoices = [], [], []
        self.items, self.ledger = [], []
        chance = random.Random(7)
        for rfc in (VICTIM, LISTED, *RING, TRUCKS, ADVISOR, DEPOSITED, *NORMAL):
            self.entities.append((rfc, f"Empresa {rfc}", None, None, "64000", rfc in NORMAL[:1]))
        self.blacklist.append((LISTED, "DEFINITIVO", dt.date(2024, 5, 1), Decimal(0)))
        for i in range(50):
            seller, buyer = NORMAL[i % 20], NORMAL[(i + 1 + i // 20) % 20]
            if seller > buyer:  # normal trade has no way back
                seller, buyer = buyer, seller
            self.sale(f"n{i}", seller, buyer, chance.uniform(8_000, 450_000),
                      "Servicios de transporte de carga")
        if not frauds:
            return
        for i, amount in enumerate((300_000, 120_000.55)):
            self.sale(f"efos{i}", LISTED, VICTIM, amount, "Servicios profesionales diversos")
        base = 805_807.0
        for i, share in enumerate((1.0, 0.97, 0.94)):
            giver, taker = RING[i], RING[(i + 1) % 3]
            self.sale(f"ring{i}", taker, giver, base * share, "Refacciones automotrices")
        self.sale("own", TRUCKS, NORMAL[0], 90_000, "Flete y transporte de mercancía")
        self.sale("vague", ADVISOR, TRUCKS, 260_000, VAGUE)
        if bank:
            self.transfer("deposit", NORMAL[1], DEPOSITED, 907_986.0, None)

    def sale(self, name, seller, buyer, amount, concept):
        amount = _money(amount * self.scale)
        self.invoices.append((f"uuid-{name}", seller, buyer, dt.datetime(2024, 3, 1), amount,
                              amount, "PUE", "03", "VIGENTE"))
        self.items.append((f"uuid-{name}", "80101500", concept, Decimal(1), amount, amount,
                           len(self.items)))
        if self.bank:
            self.ledger.append((f"tx-{name}", buyer, seller, dt.datetime(2024, 3, 10), amount,
                                "pago", f"uuid-{name}"))

    def transfer(self, name, source, target, amount, folio):
        self.ledger.append((f"tx-{name}", source, target, dt.datetime(2024, 3, 10),
                            _money(amount * self.scale), "dep", folio))

    def tables(self, spark) -> dict:
        return {
            "entities": spark.createDataFrame(self.entities, schema.ENTITIES),
            "blacklist": spark.createDataFrame(self.blacklist, schema.BLACKLIST),
            "invoices": spark.createDataFrame(self.invoices, schema.INVOICES),
            "items": spark.createDataFrame(self.items, schema.ITEMS),
            "ledger": spark.createDataFrame(self.ledger, schema.LEDGER),
            "catalog": spark.createDataFrame([], schema.SECTOR_CATALOG),
        }

    def csv_folder(self, folder) -> str:
        import csv
        from folioscope import fixed_values as fv

        rows = {"Entidades": self.entities, "Lista_69B": self.blacklist,
                "Facturas": self.invoices, "Partidas": [r[:6] for r in self.items],
                "Transacciones_Bancarias": self.ledger}
        for name, data in rows.items():
            with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
                writer = csv.writer(f)
                writer.writerow(fv.REQUIRED_COLUMNS[name])
                writer.writerows([["" if v is None else v for v in row] for row in data])
        return str(folder)
