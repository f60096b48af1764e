"""The production site's vocabulary.

Fixed values: sensor types and state words exactly as the journal spells them,
in the order in which the first match wins.
"""

from .rules import Sign, Vocabulary

EQUIPMENT = ("Состояние насоса", "Состояние вентилятора", "Состояние фазы", "ИБП", "Переключатель")
OPENINGS = ("КД Дверь", "КД Люк", "Стекло", "9-секционный люк")
FAULTS = ("Неисправен", "Отключено устройство", "Не определено")

TRIGGERS = [
    ("fire", Sign(("Датчик дыма",), ("Обнаружен дым",))),
    ("fire", Sign(("Тепловой датчик",), ("Не замкнут",))),
    ("fire", Sign(("Ручной извещатель",), ("Не замкнут", "Рычаг сдернут"))),
    ("fire", Sign(("Датчик температуры",), ("Температура выше 40ºC",))),
    ("fire", Sign(("Датчик температуры",), lo=40, hi=80)),
    ("gas", Sign(("Газовый датчик",), ("Обнаружен газ",))),
    ("flood", Sign(("Состояние насоса",), ("Затоплен", "Работают все насосы в АНС"))),
    ("flood", Sign(("Датчик затопления",), ("Не замкнут",))),
    ("equipment", Sign(("Состояние фазы",), ("Неисправен", "Отключено устройство"))),
    (
        "equipment",
        Sign(
            ("Состояние насоса", "Состояние вентилятора", "ИБП", "Переключатель"),
            ("Неисправен", "Обесточен", "Отключено устройство", "Питание от батарей", "Батарея разряжена"),
        ),
    ),
    ("sensor", Sign((), FAULTS, but=(*EQUIPMENT, "Состояние охраны"))),
    ("sensor", Sign(("Датчик температуры",), below=-40)),
    ("sensor", Sign(("Датчик температуры",), above=80)),
    ("sensor", Sign(("Газовый датчик",), below=0)),
    ("sensor", Sign(("Газовый датчик",), above=15)),
]

COUNTERS = [
    ("smoke", Sign(("Датчик дыма",), ("Обнаружен дым",))),
    ("smoke_clear", Sign(("Датчик дыма",), ("Дыма нет",))),
    ("smoke_fault", Sign(("Датчик дыма",), ("Неисправен",))),
    ("heat", Sign(("Тепловой датчик",), ("Не замкнут",))),
    ("manual", Sign(("Ручной извещатель",), ("Не замкнут", "Рычаг сдернут"))),
    ("temp_hi", Sign(("Датчик температуры",), ("Температура выше 40ºC",))),
    ("temp_lo", Sign(("Датчик температуры",), ("Температура ниже 3ºC",))),
    ("temp_fault", Sign(("Датчик температуры",), ("Неисправен", "Не определено"))),
    ("gas", Sign(("Газовый датчик",), ("Обнаружен газ",))),
    ("gas_fault", Sign(("Газовый датчик",), ("Неисправен",))),
    ("pump_on", Sign(("Состояние насоса",), ("Включен",))),
    ("pump_off", Sign(("Состояние насоса",), ("Выключен",))),
    ("pump_flooded", Sign(("Состояние насоса",), ("Затоплен",))),
    ("pump_all", Sign(("Состояние насоса",), ("Работают все насосы в АНС",))),
    ("pump_fault", Sign(("Состояние насоса",), ("Неисправен", "Обесточен"))),
    ("fan_on", Sign(("Состояние вентилятора",), ("Включен",))),
    ("fan_off", Sign(("Состояние вентилятора",), ("Выключен",))),
    ("fan_fault", Sign(("Состояние вентилятора",), ("Неисправен", "Обесточен"))),
    ("phase_off", Sign(("Состояние фазы",), ("Обесточен",))),
    ("phase_on", Sign(("Состояние фазы",), ("Есть питание",))),
    ("phase_fault", Sign(("Состояние фазы",), ("Неисправен",))),
    ("ups_batt", Sign(("ИБП",), ("Питание от батарей",))),
    ("ups_mains", Sign(("ИБП",), ("Питание от сети",))),
    ("ups_fault", Sign(("ИБП",), ("Неисправен", "Батарея неисправна", "Батарея разряжена"))),
    ("switch", Sign(("Переключатель",), ("Включен", "Выключен"))),
    ("door", Sign(("КД Дверь",), ("Не замкнут",))),
    ("hatch", Sign(("КД Люк", "9-секционный люк", "Стекло"), ("Не замкнут",))),
    ("av", Sign(("КД АВ",), ("Не замкнут",))),
    ("motion", Sign((), ("Обнаружено движение",))),
    ("uir_call", Sign(("Состояние УИР-Р",), ("Вызов", "Разговор"))),
    ("uir_lever", Sign(("Состояние УИР-Р",), ("Рычаг сдернут",))),
    ("arm", Sign(("Состояние охраны",), ("На охране",))),
    ("disarm", Sign(("Состояние охраны",), ("Снято с охраны",))),
    ("guard_faulty", Sign(("Состояние охраны",), ("Много неисправных устройств",))),
    ("flood_sensor", Sign(("Датчик затопления",), ("Не замкнут",))),
    ("fault_other", Sign((), ("Неисправен",))),
    ("disconnected", Sign((), ("Отключено устройство",))),
    ("undefined", Sign((), ("Неопределен", "Не определено"))),
    ("off", Sign((), ("Выключен",))),
    ("norm", Sign((), ("Норма",))),
]

# Families of activations, and the pairs of families that are counted per incident type.
FAMILIES = [
    ("smoke", Sign(("Датчик дыма",), ("Обнаружен дым",))),
    ("heat", Sign(("Тепловой датчик",), ("Не замкнут",))),
    ("temp_hi", Sign(("Датчик температуры",), ("Температура выше 40ºC",))),
    ("manual", Sign(("Ручной извещатель",), ("Не замкнут", "Рычаг сдернут"))),
    ("gas", Sign(("Газовый датчик",), ("Обнаружен газ",))),
    ("flood", Sign(("Датчик затопления",), ("Не замкнут",))),
    ("pump_bad", Sign(("Состояние насоса",), ("Затоплен", "Неисправен", "Обесточен"))),
    ("phase_off", Sign(("Состояние фазы",), ("Обесточен",))),
    ("ups_batt", Sign(("ИБП",), ("Питание от батарей", "Батарея разряжена", "Батарея неисправна"))),
    ("unit_bad", Sign(("Состояние вентилятора", "Состояние насоса"), ("Неисправен", "Обесточен"))),
    ("door", Sign(("КД Дверь", "КД АВ"), ("Не замкнут",))),
    ("hatch", Sign(("КД Люк", "9-секционный люк", "Стекло"), ("Не замкнут",))),
    ("motion", Sign((), ("Обнаружено движение",))),
    ("fault", Sign((), ("Неисправен", "Не определено", "Неопределен"))),
]
PAIRS = [
    ("fire", "smoke", "heat"),
    ("fire", "smoke", "temp_hi"),
    ("fire", "heat", "temp_hi"),
    ("fire", "smoke", "smoke"),
    ("fire", "smoke", "manual"),
    ("gas", "gas", "gas"),
    ("gas", "gas", "unit_bad"),
    ("flood", "flood", "pump_bad"),
    ("flood", "flood", "flood"),
    ("flood", "pump_bad", "unit_bad"),
    ("equipment", "phase_off", "ups_batt"),
    ("equipment", "phase_off", "unit_bad"),
    ("equipment", "unit_bad", "unit_bad"),
    ("sensor", "fault", "fault"),
    ("intrusion", "door", "motion"),
    ("intrusion", "hatch", "motion"),
    ("intrusion", "door", "door"),
]

SITE = Vocabulary(
    triggers=TRIGGERS,
    counters=COUNTERS,
    armed=Sign(("Состояние охраны",), ("На охране",)),
    disarmed=Sign(("Состояние охраны",), ("Снято с охраны",)),
    openings=(Sign(OPENINGS, ("Не замкнут",)),),
    motion=(Sign(("Датчик движения",), ("Обнаружено движение",)), Sign(("КД АВ",), ("Не замкнут",))),
    doors=(Sign(("КД Дверь", "КД Люк"), ("Не замкнут",)),),
    visit_motion=(Sign(("Датчик движения",), ("Обнаружено движение",)),),
    mass=Sign(("Датчик дыма",)),
    flooded=Sign((), ("Затоплен",)),
    power_back=(
        Sign(("Состояние фазы",), ("Есть питание",)),
        Sign(("ИБП",), ("Питание от сети",)),
        Sign(("Переключатель",), ("Включен",)),
    ),
    power_lost=(Sign(("Состояние фазы",), ("Обесточен",)), Sign(("ИБП",), ("Питание от батарей",))),
    gas=Sign(("Газовый датчик",), lo=0, hi=15),
    temperature=Sign(("Датчик температуры",), lo=-40, hi=80),
    undefined=("Неопределен", "Не определено"),
    link_skip=("Состояние УИР-Р",),
)

GUARD_STYPE = "Состояние охраны"
# a guard state never starts like a date, masked dates included
GUARD_DATE = r"^[0-9#]{2}\.[0-9#]{2}\."
