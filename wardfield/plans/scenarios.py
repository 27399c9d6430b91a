"""The variable sets that are compared with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import reshape

# ---- Fixed values: columns left out of each variable set -------------------
ALWAYS_DROPPED = ["hd40"]
OTHER_TARGET = ["R34"]
DROPPED_SOCIO = ["yr_sch", "rnna", "HCI", "TerritorialEmiss_tCO2PC"]
DROPPED_CLIMATE = ["cwd", "r50mm", "rx5day", "hi41", "hi35", "tr29"]
KEPT_SOCIO = ["CarbonIntens_Electr", "EnerIntens_PrimEnergy", "HDI", "csh_g", "rgdpna", "EmpRate",
              "TerritorialEmiss_IntensGDP_KgThs", "TradeOpenness"]
KEPT_CLIMATE = ["cdd", "hd30", "pr", "tas", "tx84rr", "wsdi"]
DROPPED_PATTERN = "Share"
SCENARIOS = {
    "AwareClimateSocio": [],
    "AwareClimate": KEPT_SOCIO,
    "AwareSocio": KEPT_CLIMATE,
}
MAIN = "Awareness only (main)"
MAIN_TARGET = "R12"
# ----------------------------------------------------------------------------


def scenario_columns(wide: DataFrame, main_target: str = MAIN_TARGET) -> dict[str, list[str]]:
    """Feature columns per scenario, resolved from the schema."""
    base = reshape.drop_columns(wide, ALWAYS_DROPPED + OTHER_TARGET + DROPPED_SOCIO + DROPPED_CLIMATE)
    base = reshape.drop_matching(base, DROPPED_PATTERN)
    sets = {name: reshape.numeric_columns(reshape.drop_columns(base, extra))
            for name, extra in SCENARIOS.items()}
    return {**sets, MAIN: [main_target]}
