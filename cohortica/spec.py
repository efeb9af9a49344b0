"""Column roles of a person-period panel."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key, label and score columns.

    The defaults are the column names of the published panel schema, so tables
    in that layout work without any configuration.
    """

    entity: str = "id_cliente"
    period: str = "mes"
    label: str = "objetivo"
    score: str = "prediccion"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.period]


DEFAULT = PanelSpec()

# Column names of the published panel schema, by kind.
NUMERIC_COLUMNS = [
    "edad", "ingresos", "ratio_deuda_ingresos", "antiguedad_cuenta_meses",
    "numero_productos", "saldo_promedio", "dias_ultima_transaccion",
    "antiguedad_direccion_meses", "visitas_web_ultimos_90_dias",
    "distancia_sucursal_km", "dia_preferido_pago", "dias_ultima_interaccion",
]
CATEGORICAL_COLUMNS = [
    "ocupacion", "region", "canal_adquisicion", "banda_riesgo",
    "dispositivo_principal",
]
BOOLEAN_COLUMNS = [
    "tiene_tarjeta_credito", "activo_movil", "es_nuevo_cliente",
    "tiene_prestamo", "tiene_seguro",
]
UNKNOWN_CATEGORY = "__UNKNOWN__"
