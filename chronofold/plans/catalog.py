"""Imports every module that registers queries."""

from chronofold.plans import q_fsm, q_functions, q_log, q_profiles, q_replay, q_shapes, q_temporal, q_timing  # noqa: F401
