"""The catalogue's rules for components, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.operators import components
from specloom.operators.rules import Rule, compiled

#: Fixed values. Which component a record has, and why it has none, in the order in which the rules are tried.
RULES = [
    Rule("engine", 1, id="{engine_id}", code=["*"]),
    Rule("engine", 2, reason="нет ДВС (BEV)", powertrain=["BEV"]),
    Rule("engine", 3, reason="код двигателя неизвестен"),
    Rule("hybrid_system", 1, id="byd_dm_5.0", family=["byd_*"], code=["BYD472QC"]),
    Rule("hybrid_system", 2, id="byd_dm_5.0", family=["byd_leopard-7"]),
    Rule("hybrid_system", 3, id="byd_dmi_4.0", family=["byd_*"]),
    Rule("hybrid_system", 4, id="lynk_em-p", family=["lynk-co_900"]),
    Rule("hybrid_system", 5, id="zeekr_sep", family=["zeekr_8x"]),
    Rule("hybrid_system", 6, id="toyota_ths_5", family=["toyota_*"]),
    Rule("hybrid_system", 7, reason="не гибрид (ICE/BEV)", powertrain=["ICE", "BEV"]),
    Rule("hybrid_system", 8, id="{fingerprint}"),
    Rule("hybrid_system", 9, reason="гибрид без подтверждённого названия и без полного технического отпечатка"),
    Rule("transmission", 1, id="byd_ehs_ecvt_dm5", family=["byd_*"], code=["BYD472QC"]),
    Rule("transmission", 2, id="byd_ehs_ecvt_dm5", family=["byd_leopard-7"]),
    Rule("transmission", 3, id="byd_ehs_ecvt_dmi4", family=["byd_*"]),
    Rule("transmission", 4, id="lynk_em-p_3dht", family=["lynk-co_900"]),
    Rule("transmission", 5, id="zeekr_sep_1dht", family=["zeekr_8x"]),
    Rule("transmission", 6, id="toyota_ths5_ecvt", family=["toyota_*"]),
    Rule("transmission", 7, id="aisin_8at", family=["changan_cs75-plus"], gearbox=["AT"], year=[2022, 2023], has=["第二代"], lacks=["第三代"]),
    Rule("transmission", 8, id="aisin_8at", family=["changan_cs75-plus"], gearbox=["AT"], year=[2025], has=["第四代"], lacks=["冠军版"]),
    Rule("transmission", 9, reason="Aisin 8AT подтверждён только для 第二代 и 第四代 (2025); здесь другое/смешанное поколение или 6AT", family=["changan_cs75-plus"], gearbox=["AT"]),
    Rule("transmission", 10, reason="механика: тип/поставщик не подтверждены", family=["changan_cs75-plus"]),
    Rule("transmission", 11, id="changan_bluewhale_7dct_wet", family=["changan_cs55-plus"], gearbox=["DCT"], code=["JL473*"]),
    Rule("transmission", 12, id="changan_bluewhale_7dct_wet", family=["changan_uni-v"], gearbox=["DCT"], year=[2025]),
    Rule("transmission", 13, reason="редуктор EV/EREV — тип/поставщик не указаны", gearbox=["Редуктор"]),
    Rule("transmission", 14, reason="7DCT: мокрое сцепление/поставщик для этого года источником не подтверждены", family=["changan_uni-v", "changan_cs75", "changan_cs55-plus"], gearbox=["DCT"]),
    Rule("transmission", 15, reason="E-CVT Changan: поколение гибридной трансмиссии не подтверждено", gearbox=["E-CVT"]),
    Rule("transmission", 16, reason="{gearbox}: поставщик/поколение не подтверждены", gearbox=["*"]),
    Rule("transmission", 17, reason="BEV: редуктор, тип/поставщик не указаны", powertrain=["BEV"]),
    Rule("transmission", 18, reason="нет данных о трансмиссии"),
]


def fields(records: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """What the rules ask of records (slug, model, my, generation, transmission, powertrain_type, engine, motor): fields and computed ids."""
    code = F.nullif(F.trim("engine.code"), F.lit(""))
    brand, gearbox = components.model_brand(F.col("model")), F.col("transmission")
    own = {
        "family": components.family(F.col("slug")), "code": code, "powertrain": F.col("powertrain_type"), "year": F.col("my"), "gearbox": gearbox, "generation": F.col("generation"),
    }
    powers = components.motor_powers(F.col("motor.front_kw"), F.col("motor.rear_kw"), F.col("motor.power_kw"))
    made = {
        "engine_id": components.engine_id(brand, code, F.col("engine.displacement_cc"), F.col("engine.aspiration")),
        "fingerprint": components.fingerprint(brand, F.col("powertrain_type"), code, powers, gearbox),
    }
    return own, made


def assigned(records: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``records`` with components and components_null_reason by ``rules`` (the catalogue's own)."""
    return components.with_components(records, compiled(RULES if rules is None else rules, *fields(records)))
