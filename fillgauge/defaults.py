"""Parameter defaults and fixed values shared by the jobs."""

from __future__ import annotations

# Status thresholds and horizons.
EMPTY_BELOW = 5
FULL_BELOW = 2
STOCKOUT_BELOW = 2
DECISION_THRESHOLD = 0.60
HORIZON_ROWS = 6
HOURLY_HORIZON_ROWS = 1
HORIZON_MINUTES = 30
TRAIN_FRACTION = 0.8
EMPTY_CANDIDATES = (2, 3, 4, 5)
PING_MINUTES = 5

#: Frames of snapshots, and for how many of them a silent station keeps its last reading (a day).
FRAME_SECONDS = 300
HOLD_FRAMES = 288
#: Share of all stations that a complete snapshot has.
COMPLETE_SHARE = 0.9

# Published rush-hour variants (inclusive hour ranges).
RUSH_THREE_PEAKS = ((7, 9), (14, 16), (18, 20))
RUSH_COMMUTE = ((7, 9), (17, 19))
RUSH_COMMUTE_LONG = ((7, 9), (17, 20))

# Public holidays of 2026.
HOLIDAYS_2026 = (
    "2026-01-01", "2026-01-06", "2026-04-02", "2026-04-03",
    "2026-05-01", "2026-05-17", "2026-07-25", "2026-08-15",
    "2026-10-12", "2026-11-01", "2026-12-06", "2026-12-08", "2026-12-25",
)

# Band edges and labels (right-closed bins).
TREND_EDGES = (-0.1, -0.02, 0.02, 0.1)
TREND_LABELS = ("bajada_fuerte", "bajada", "estable", "subida", "subida_fuerte")
INCOME_EDGES = (0, 28000, 35000, 70000)
INCOME_LABELS = ("Baja", "Media", "Alta")
PRIORITY_EDGES = (0, 40, 60, 100)
PRIORITY_LABELS = ("Baja", "Media", "Alta")

# Siting weights.
SITING_WEIGHTS = {
    "population": 0.30,
    "coverage": 0.25,
    "income": 0.20,
    "density": 0.15,
    "connectivity": 0.10,
}

# Day names of the frame export, Monday first.
DAY_NAMES_ES = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")

# Texts of the reports.
ACTION_EXPAND = "Ampliar Docks (+5)"
ACTION_REBALANCE = "Rebalanceo Prioritario"
DAY_BUSY = "MUY ACTIVO"
DAY_QUIET = "MUY INACTIVO"
ARCHETYPE_HOME = "RESIDENCIAL (Salen manana)"
ARCHETYPE_WORK = "TRABAJO/OFICINAS (Llegan manana)"
ARCHETYPE_LEISURE = "OCIO/HOSTELERIA (Pico mediodia)"
ARCHETYPE_MIXED = "MIXTO/ROTACION CONSTANTE"
REASON_PEOPLE = "Alta poblacion (%d hab)"
REASON_UNSERVED = "Sin cobertura actual (zona desatendida)"
REASON_SPARSE = "Cobertura insuficiente"
REASON_INCOME = "Poder adquisitivo alto (sostenibilidad economica)"
REASON_DENSE = "Alta densidad urbana"

# Source header -> canonical column of the snapshot feed.
TRACKING_ALIASES = {
    "timestamp": "ts", "id": "station_id", "nombre": "station_name", "name": "station_name",
    "lat": "lat", "lon": "lon", "capacidad": "capacity", "bicis": "bikes", "docks": "docks",
    "ocupación": "occupancy_raw", "ocupacion": "occupancy_raw", "vacía": "is_empty", "vacia": "is_empty",
    "llena": "is_full", "delta": "delta_bikes", "hora": "hour", "día": "day_of_week", "dia": "day_of_week",
    "finde": "is_weekend", "festivo": "is_holiday", "punta": "is_rush_hour",
    "turismo": "is_tourist_season", "temp": "temp", "lluvia": "rain", "viento": "wind", "clima": "weather_type",
}

# Most rows one ordered slice of a hot key should hold.
MAX_SLICE_ROWS = 1_000_000
# Most rows of a lookup side that may be broadcast.
MAX_BROADCAST_ROWS = 200_000
