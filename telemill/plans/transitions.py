"""From interface counters to observation vectors, rewards and time steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.timegrid import epoch_us, micros
from telemill.operators.rangefn import rate
from telemill.operators.replay import timesteps
from telemill.operators.reward import with_hourly_reward
from telemill.operators.rollup import observation_vector


def interface_rates(counters: DataFrame, key: Sequence[str], d="1 hour", step="1 minute") -> DataFrame:
    """Rate of every interface ``(key..., t, rate)``; ``key`` names node, direction and iface."""
    return rate(counters, key, d, step)


def hourly_observations(counters: DataFrame, key: Sequence[str], nodes: DataFrame, d="1 hour", step="1 minute") -> DataFrame:
    """Observation vector, total throughput and reward at every grid time."""
    return with_hourly_reward(observation_vector(interface_rates(counters, key, d, step), nodes))


def episode_steps(obs: DataFrame, episode_width, step, policy: Column | None = None) -> DataFrame:
    """Number observations by grid time: one episode per ``episode_width``, steps counted from 1.

    The numbers follow from the time itself, so nothing has to be sorted. ``policy`` is an expression
    over the observation columns that gives each step's action.
    """
    width, s = micros(episode_width), micros(step)
    e = epoch_us("t")
    episode = F.floor(e / F.lit(width)).cast("bigint")
    place = ((e - episode * F.lit(width)) / F.lit(s)).cast("bigint") + 1
    steps = timesteps(obs.withColumn("episode", episode).withColumn("step", place))
    return steps if policy is None else steps.withColumn("action", policy)
