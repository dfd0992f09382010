"""Derived behaviour, device and network columns, and upgrades of legacy session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import columns as C
from sessionloom.functions.score import bot_score
from sessionloom.operators.ranks import average_rank
from sessionloom.operators.structure import align_schema, with_defaults
from sessionloom.plans.cuts import quantiles
from sessionloom.schema import (
    BINARY_ODDS,
    BOT_AGENTS,
    BROWSERS,
    DATACENTRE_PREFIXES,
    REGIONS,
    RESIDENTIAL_PREFIXES,
    THREE_CLASS_ODDS,
)

DEVICE_COLUMNS = ["browser", "operating_system", "device_type", "user_agent", "ip_address", "country", "region", "is_proxy"]


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("bot_likelihood_score", bot_score(df))


def behavioural_proxies(sessions: DataFrame) -> DataFrame:
    """Motion-like columns as deterministic transforms of click cadence and dispersion."""
    zero = F.lit(0.0)
    pause = F.greatest(F.coalesce("click_interval_mean", zero), F.lit(0.05))
    spread = F.coalesce("click_interval_std", zero) / (pause + 1.0)
    cadence = F.log1p(F.greatest("requests_per_minute", zero))
    surprise = F.coalesce("click_interval_entropy", zero)
    n = F.col("click_count")
    speed = C.clip(120.0 / (pause + 0.5) + 18.0 * surprise, 15.0, 320.0)
    speed_std = C.clip(4.0 + 14.0 * spread + 3.0 * surprise, 0.5, 120.0)
    out = sessions.withColumns(
        {
            "mouse_speed_mean": speed,
            "mouse_speed_std": speed_std,
            "coordinate_entropy": C.clip(0.9 + 1.2 * surprise + 0.4 * spread, 0.1, 8.0),
            "direction_change_count": F.greatest(F.rint((n - 1) * (0.65 + 0.35 * surprise)), zero).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "mouse_path_length": F.greatest(
                F.lit(20.0),
                F.col("mouse_speed_mean") * F.sqrt(F.greatest(n, F.lit(1))) * (1.0 + 0.25 * cadence),
            ),
            "movement_std": F.greatest(F.lit(0.2), 0.35 * F.col("mouse_speed_std") + 0.2 * cadence),
            "mouse_acceleration_std": F.greatest(F.lit(0.1), F.col("mouse_speed_std") / (pause + 1.0)),
        }
    )
    bend = F.col("direction_change_count") / F.greatest("mouse_path_length", F.lit(1.0))
    return out.withColumn("movement_curvature", C.clip(bend, 0.0, 5.0))


Z_COLUMNS = [
    "clicks_per_minute", "requests_per_minute", "click_interval_mean", "click_interval_std", "channel_entropy",
    "app_entropy", "session_duration_sec", "install_count",
]


def fitted_z(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """z-scores with population deviation (0 -> 1), NULL as 0; one aggregate fits all columns."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    fit = df.agg(
        *[F.avg(x).alias(f"m_{c}") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()],
    ).first()
    return {c: (x - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0) for c, x in filled.items()}


def behavioural_proxies_noisy(sessions: DataFrame, noise: bool = True, exact: bool = True) -> DataFrame:
    """Eleven behaviour columns from z-score models by class, with keyed normal noise.

    ``noise=False`` gives the expectation of every column.
    """
    z = fitted_z(sessions, Z_COLUMNS)
    bot = F.col("label").cast("double")
    human = 1.0 - bot
    rate, irregular, installs = z["requests_per_minute"], z["click_interval_std"], z["install_count"]
    diversity = (z["channel_entropy"] + z["app_entropy"]) / 2.0

    def eps(i: int, scale: float) -> Column:
        return scale * C.standard_normal(F.col("session_id"), f"behaviour{i}") if noise else F.lit(0.0)

    n = F.col("click_count")
    base = sessions.withColumns(
        {
            "_speed": 145 + 28 * human + 12 * rate + 10 * diversity - 14 * bot + eps(0, 8),
            "_speed_std": 34 + 12 * human + 8 * irregular + 6 * diversity - 16 * bot + eps(1, 4),
            "_turns": F.greatest(n - 1, F.lit(0)) * (0.42 + 0.16 * human + 0.10 * diversity - 0.14 * bot) + eps(3, 2),
            "_scroll": 2.5 + 0.014 * F.col("session_duration_sec") + 6 * human + 4 * diversity - 5.5 * bot + eps(6, 1.5),
            "_coord": 2.6 + 1.1 * human + 0.45 * diversity + 0.20 * irregular - 1.15 * bot + eps(8, 0.18),
        }
    )
    path = F.greatest(n, F.lit(1)) * (0.72 * F.col("_speed") + 18 * diversity + 6 * irregular + eps(2, 4))
    hover = 1.20 + 0.18 * human + 0.12 * installs - 0.20 * rate - 0.15 * bot + eps(4, 0.08)
    hover_std = 0.55 + 0.24 * human + 0.18 * irregular - 0.22 * bot + eps(5, 0.05)
    depth = 28 + 8.5 * F.log1p(F.greatest("_scroll", F.lit(0.0))) + 16 * human + 7 * diversity - 14 * bot + eps(7, 3)
    accel = 0.85 + 0.018 * F.col("_speed_std") + 0.12 * F.col("_coord") + 0.08 * human - 0.12 * bot + eps(9, 0.04)
    out = base.withColumns(
        {
            "mouse_speed_mean": C.clip(F.col("_speed"), low=35.0),
            "mouse_speed_std": C.clip(F.col("_speed_std"), low=4.0),
            "mouse_path_length": C.clip(path, low=50.0),
            "direction_change_count": F.greatest(F.rint("_turns"), F.lit(0.0)).cast("long"),
            "hover_time_mean": C.clip(hover, low=0.05),
            "hover_time_std": C.clip(hover_std, low=0.01),
            "scroll_count": F.greatest(F.rint("_scroll"), F.lit(0.0)).cast("long"),
            "scroll_depth": C.clip(depth, 0.0, 100.0),
            "coordinate_entropy": C.clip(F.col("_coord"), 0.05, 8.5),
            "cursor_acceleration_std": C.clip(accel, low=0.01),
        }
    ).drop("_speed", "_speed_std", "_turns", "_scroll", "_coord")
    out = out.withColumn("movement_std", F.greatest(F.lit(0.5), 0.42 * F.col("mouse_speed_std") + 4.0))
    return bot_score_quantile(out, exact=exact)


def bot_score_quantile(df: DataFrame, exact: bool = True) -> DataFrame:
    """2.2 for a top-5 % rate, 1.6 / 1.4 for bottom-10 % entropy / speed deviation, 1.1 per label."""
    cuts = quantiles(df, ["requests_per_minute", "coordinate_entropy", "mouse_speed_std"], [0.10, 0.95], exact=exact)
    score = (
        2.2 * (F.col("requests_per_minute") > cuts["requests_per_minute"][1]).cast("int")
        + 1.6 * (F.col("coordinate_entropy") < cuts["coordinate_entropy"][0]).cast("int")
        + 1.4 * (F.col("mouse_speed_std") < cuts["mouse_speed_std"][0]).cast("int")
        + 1.1 * F.col("label")
    )
    return df.withColumn("bot_likelihood_score", score)


# --- device and network ------------------------------------------------------------------


def user_agent(browser: Column, system: Column, headless: Column, major: Column, build: Column, version_divisor: int = 8) -> Column:
    """User-agent text of a browser and operating system."""
    major_s, build_s = major.cast("string"), build.cast("string")
    webkit = F.lit("AppleWebKit/537.36 (KHTML, like Gecko)")
    number = F.concat(major_s, F.lit(".0."), build_s, F.lit(".0"))
    desktop = F.lit("Mozilla/5.0 (Windows NT 10.0; Win64; x64)")
    safari_version = F.greatest(F.lit(15), F.floor(major / version_divisor)).cast("string")
    token = F.when(system == "Linux", "X11; Linux x86_64").otherwise("Windows NT 10.0; Win64; x64")
    return (
        F.when(
            headless & (browser == "Chrome"),
            F.concat(F.lit("Mozilla/5.0 (X11; Linux x86_64) "), webkit, F.lit(" HeadlessChrome/"), number, F.lit(" Safari/537.36")),
        )
        .when(
            browser == "Safari",
            F.concat(
                F.lit("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/"),
                safari_version,
                F.lit(".0 Safari/605.1.15"),
            ),
        )
        .when(
            browser == "Firefox",
            F.concat(F.lit("Mozilla/5.0 ("), token, F.lit("; rv:"), major_s, F.lit(".0) Gecko/20100101 Firefox/"), major_s, F.lit(".0")),
        )
        .when(
            browser == "Edge",
            F.concat(desktop, F.lit(" "), webkit, F.lit(" Chrome/"), number, F.lit(" Safari/537.36 Edg/"), number),
        )
        .otherwise(F.concat(desktop, F.lit(" "), webkit, F.lit(" Chrome/"), number, F.lit(" Safari/537.36")))
    )


def ipv4(key: Column, datacentre: Column) -> Column:
    """Address with a first octet from the class's prefix pool; the last octet is 1..254."""
    pool_draw = C.uniform(key, "ip0")
    first = F.when(datacentre, C.pick(DATACENTRE_PREFIXES, pool_draw)).otherwise(C.pick(RESIDENTIAL_PREFIXES, pool_draw))
    octet = lambda salt: F.floor(C.uniform(key, salt) * 256)
    return F.concat_ws(".", first, octet("ip1"), octet("ip2"), F.floor(C.uniform(key, "ip3") * 254) + 1)


def region_of(country: Column, draw: Column) -> Column:
    out = None
    for name, regions in REGIONS.items():
        value = C.pick(regions, draw)
        out = F.when(country == name, value) if out is None else out.when(country == name, value)
    return out


def device_network_enrich(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Browser, system, device, agent, address, place and proxy by class-conditional odds.

    Every draw is a hash of the session id and a per-draw salt. The agent's version is
    keyed by browser and system (plus the class for bots), not by whichever row came first.
    """
    odds, k = THREE_CLASS_ODDS, F.col(key)
    label = F.coalesce(F.col("label").cast("int"), F.lit(0))
    bot, advanced = label > 0, label == 2
    u = lambda salt: C.uniform(k, salt)
    first = sessions.withColumns(
        {
            "browser": C.weighted_choice(u("browser"), BROWSERS),
            "operating_system": F.when(bot & (u("linux") < odds["bot_linux"]), "Linux").otherwise(
                C.weighted_choice(u("os"), odds["operating_system"])
            ),
            "country": C.weighted_choice(u("country"), odds["country"]),
            "is_proxy": (u("proxy") < F.when(bot, odds["bot_proxy"]).otherwise(odds["human_proxy"])).cast("int"),
        }
    )
    mobile = F.when(F.col("operating_system").isin("Android", "iOS"), "mobile").otherwise(
        C.weighted_choice(u("device"), odds["device_type"])
    )
    device = (
        F.when(bot & (u("server") < odds["bot_server"]), "server")
        .when(advanced & (u("desktop") < odds["advanced_desktop"]), "desktop")
        .otherwise(mobile)
    )
    frac = C.stable_fraction(F.concat_ws("|", F.col("browser"), F.col("operating_system")))
    agent = user_agent(
        F.col("browser"), F.col("operating_system"), bot, F.floor(118 + frac * 8), F.floor(4200 + frac * 900)
    )
    second = first.withColumns(
        {
            "device_type": device,
            "region": region_of(F.col("country"), u("region")),
            "ip_address": ipv4(k, (F.col("is_proxy") == 1) | bot),
            "user_agent": agent,
        }
    )
    return with_score(second)


def device_network_enrich_binary(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Two-class variant with its own odds; bots take one of three fixed agents, versions vary per row."""
    odds, k = BINARY_ODDS, F.col(key)
    bot = F.coalesce(F.col("label").cast("int"), F.lit(0)) == 1
    u = lambda salt: C.uniform(k, salt)
    first = sessions.withColumns(
        {
            "browser": C.weighted_choice(u("browser"), BROWSERS),
            "operating_system": F.when(bot & (u("linux") < odds["bot_linux"]), "Linux").otherwise(
                C.weighted_choice(u("os"), odds["operating_system"])
            ),
            "country": C.weighted_choice(u("country"), odds["country"]),
            "is_proxy": (u("proxy") < F.when(bot, odds["bot_proxy"]).otherwise(odds["human_proxy"])).cast("int"),
        }
    )
    mobile = F.when(F.col("operating_system").isin("Android", "iOS"), "mobile").otherwise(
        C.weighted_choice(u("device"), odds["device_type"])
    )
    major = C.clip(F.rint(122 + 3 * C.standard_normal(k, "major")), 110.0, 132.0).cast("long")
    build = C.clip(F.rint(4500 + 180 * C.standard_normal(k, "build")), 1000.0, 7000.0).cast("long")
    system = F.when(F.col("operating_system").isin("Windows", "MacOS"), "Windows").otherwise("Linux")
    agent = F.when(bot, C.pick(BOT_AGENTS, u("agent"))).otherwise(
        user_agent(F.col("browser"), system, F.lit(False), major, build)
    )
    return first.withColumns(
        {
            "device_type": F.when(bot & (u("desktop") < odds["bot_desktop"]), "desktop").otherwise(mobile),
            "region": region_of(F.col("country"), u("region")),
            "ip_address": ipv4(k, bot),
            "user_agent": agent,
        }
    )


# --- legacy upgrades ---------------------------------------------------------------------


def legacy_span(df: DataFrame) -> DataFrame:
    """session_start from date text and time-range prefix, session_end by the duration."""
    if "session_start" in df.columns:
        return df
    start = C.parse_session_start(F.col("activity_date"), F.col("time_range"))
    out = df.withColumn("session_start", start)
    return out.withColumn(
        "session_end", C.add_seconds(F.col("session_start"), F.coalesce("session_duration_sec", F.lit(0.0)))
    )


def upgrade_legacy_sessions(df: DataFrame, align: bool = True) -> DataFrame:
    """Three-class upgrade of an older session table: constants, span, absent columns derived."""
    entropy = F.coalesce("coordinate_entropy", F.lit(0.0))
    out = df.withColumns(
        {
            "label": F.lit(2),
            "bot_type": F.lit("advanced_bot"),
            "data_source": F.lit("legacy_advanced"),
            "data_source_detail": F.lit("preexisting_session_aggregated_dataset"),
            "candidate_human": F.lit(False),
        }
    )
    out = legacy_span(out)
    clicks = "click_count" if "click_count" in out.columns else "total_requests"
    out = out.withColumn("click_count", F.coalesce(F.col(clicks), F.lit(0)).cast("long"))
    out = with_defaults(
        out,
        {
            "install_count": F.lit(0).cast("long"),
            "successful_requests": F.lit(0).cast("long"),
            "device_entropy": entropy / 4.0,
            "channel_entropy": entropy / 3.0,
            "app_entropy": entropy / 3.5,
            "click_interval_mean": F.col("request_interval_mean"),
            "click_interval_std": F.col("request_interval_std"),
            "click_interval_entropy": entropy / 3.0,
            "request_interval_entropy": F.col("click_interval_entropy"),
            "session_idle_ratio": 0.0,
            "mouse_acceleration_std": F.coalesce("mouse_speed_std", F.lit(0.0)) / 5.0,
            "movement_curvature": F.coalesce("direction_change_count", F.lit(0))
            / C.clip(F.col("mouse_path_length"), low=1.0),
        },
    )
    return align_schema(out) if align else out


def upgrade_legacy_sessions_binary(df: DataFrame, enrich: bool = True) -> DataFrame:
    """Two-class upgrade; the combo rate is one minus the percentile rank of the entropy."""
    bot = F.coalesce(F.col("label").cast("int"), F.lit(0)) != 0
    out = df.withColumns(
        {
            "data_source": F.lit("existing_clickstream"),
            "label": bot.cast("int"),
            "bot_type": F.when(bot, "existing_clickstream_bot").otherwise("existing_clickstream_human"),
        }
    )
    requests = F.coalesce("total_requests", F.lit(0))
    out = with_defaults(
        out,
        {
            "click_count": F.col("total_requests"),
            "install_count": F.lit(0).cast("long"),
            "click_interval_mean": F.col("request_interval_mean"),
            "click_interval_std": F.col("request_interval_std"),
            "ip_click_frequency": requests,
            "device_click_frequency": F.coalesce(F.col("total_movements"), requests),
            "ip_install_rate": 0.0,
        },
    )
    if "combo_repeat_rate" not in out.columns:
        out = average_rank(out, "coordinate_entropy", "_pct", pct=True)
        out = out.withColumn("combo_repeat_rate", F.coalesce(1.0 - F.col("_pct"), F.lit(0.5))).drop("_pct")
    out = with_defaults(out, {"device_entropy": 0.0, "channel_entropy": F.col("coordinate_entropy") / 8.0})
    out = with_defaults(out, {"app_entropy": F.col("channel_entropy")})
    if "session_start" not in out.columns:
        out = legacy_span(out)
    missing = F.lit(None)
    out = with_defaults(
        out,
        {c: missing.cast("long") for c in ("original_ip", "original_device", "original_os", "app", "device", "os", "channel")},
    )
    parts = C.calendar_parts(F.col("session_start"))
    out = with_defaults(out, {p: F.coalesce(x, F.lit(0)) for p, x in parts.items()})
    if not enrich:
        return out
    behaviour = ["hover_time_mean", "hover_time_std", "scroll_count", "scroll_depth", "cursor_acceleration_std"]
    if any(c not in out.columns for c in behaviour):
        out = behavioural_proxies_noisy(out)
    absent = [c for c in DEVICE_COLUMNS if c not in out.columns]
    if absent:
        own = {c: F.col(c) for c in DEVICE_COLUMNS if c in out.columns}
        kept = out.withColumns({f"_own_{c}": x for c, x in own.items()})
        drawn = device_network_enrich_binary(kept)
        out = drawn.withColumns({c: F.col(f"_own_{c}") for c in own}).drop(*[f"_own_{c}" for c in own])
    return out.withColumn("is_proxy", F.col("is_proxy").cast("int"))
