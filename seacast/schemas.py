"""Schemas of the landed and derived tables (canonical lower-case names)."""

from __future__ import annotations

from pyspark.sql import types as T

# Headers of the landed crossing log and of the clean table -> canonical names.
SOURCE_NAMES = {
    "Horaire": "horaire",
    "Annulation": "annulation",
    "AnnulationMotif": "annulation_motif",
    "Ligne": "ligne",
    "Météo": "meteo",
    "Vent": "vent",
    "VentNoeud": "vent_noeud",
    "HouleDominante": "houle_dominante",
    "HouleMax": "houle_max",
    "Houle": "houle",
    "HoulePeriode": "houle_periode",
    "Mer": "mer",
    "Temperature": "temperature",
    "Ciel": "ciel",
    "Bateau": "bateau",
    "Capitaine": "capitaine",
}


def _fields(names, dtype):
    return [T.StructField(name, dtype, True) for name in names]


RAW_CROSSINGS = T.StructType(
    _fields(["Horaire", "Ligne", "Annulation", "Météo", "Bateau", "Capitaine"], T.StringType())
)

CLEAN_CROSSINGS = T.StructType(
    [
        T.StructField("horaire", T.TimestampNTZType()),
        T.StructField("annulation", T.IntegerType()),
        T.StructField("annulation_motif", T.StringType()),
        T.StructField("ligne", T.StringType()),
        T.StructField("vent", T.StringType()),
        T.StructField("vent_noeud", T.DoubleType()),
        T.StructField("houle_dominante", T.DoubleType()),
        T.StructField("houle_max", T.DoubleType()),
        T.StructField("houle", T.DoubleType()),
        T.StructField("houle_periode", T.DoubleType()),
        T.StructField("mer", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("ciel", T.StringType()),
        T.StructField("bateau", T.StringType()),
        T.StructField("capitaine", T.StringType()),
    ]
)

# The daily measures of the two payload halves, payload name -> column name.
MARINE_MEASURES = {
    "wave_height_max": "wave_height_max",
    "wave_direction_dominant": "wave_direction_dominant",
    "wave_period_max": "wave_period_max",
    "wind_wave_height_max": "wind_wave_height_max",
    "swell_wave_height_max": "swell_wave_height_max",
}
WEATHER_MEASURES = {
    "temperature_2m_max": "temperature_max",
    "temperature_2m_min": "temperature_min",
    "wind_speed_10m_max": "wind_speed_max",
    "wind_gusts_10m_max": "wind_gusts_max",
    "wind_direction_10m_dominant": "wind_direction_dominant",
}
MEASURES = list(MARINE_MEASURES.values()) + list(WEATHER_MEASURES.values())

WEATHER_DAILY = T.StructType(
    [T.StructField("date", T.DateType())] + _fields(MEASURES, T.DoubleType())
)
# Monthly files keep the date as text: the keep-first rule compares the raw text.
WEATHER_LANDED = T.StructType(
    [T.StructField("date", T.StringType())] + _fields(MEASURES, T.DoubleType())
)


def _daily(measures):
    return T.StructType(
        [
            T.StructField(
                "daily",
                T.StructType(
                    [T.StructField("time", T.ArrayType(T.StringType()))]
                    + _fields(measures, T.ArrayType(T.DoubleType()))
                ),
            )
        ]
    )


WEATHER_PAYLOAD = T.StructType(
    [
        T.StructField("period_start", T.StringType()),
        T.StructField("period_end", T.StringType()),
        T.StructField("marine_data", _daily(MARINE_MEASURES)),
        T.StructField("weather_data", _daily(WEATHER_MEASURES)),
    ]
)

SCORE_REQUEST = T.StructType(_fields(MEASURES, T.DoubleType()))

MODEL_RUNS = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("run_at", T.TimestampType()),
        T.StructField("data_source", T.StringType()),
        T.StructField("input_path", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("n_features", T.LongType()),
        T.StructField("target_rate", T.DoubleType()),
        T.StructField("active", T.BooleanType()),
    ]
)
