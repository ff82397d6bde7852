"""Parameters of a derived dataset."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RolloutSpec:
    """Dims, window lengths and instability thresholds; the defaults are the data model's fixed values."""

    cond_steps: int = 3
    horizon_steps: int = 16
    state_dim: int = 64
    cmd_dim: int = 58
    action_dim: int = 29
    ang_threshold: float = 2.2
    joint_threshold: float = 14.6
    lin_threshold: float = 0.9
    # [start, end) of each velocity segment within a state vector
    joint_velocity: tuple[int, int] = (29, 58)
    linear_velocity: tuple[int, int] = (58, 61)
    angular_velocity: tuple[int, int] = (61, 64)

    def __post_init__(self):
        if self.cond_steps < 1 or self.horizon_steps < 1:
            raise ValueError("cond_steps and horizon_steps must be at least 1")
        if self.cmd_dim > self.state_dim:
            raise ValueError(f"cmd_dim {self.cmd_dim} is larger than state_dim {self.state_dim}")

    def meta(self) -> dict[str, str]:
        """The parameters a dataset records about itself."""
        kept = ("cond_steps", "horizon_steps", "state_dim", "cmd_dim")
        values = asdict(self)
        out = {name: str(values[name]) for name in kept}
        out["recovery_base_ang_thr"] = str(self.ang_threshold)
        out["recovery_joint_vel_thr"] = str(self.joint_threshold)
        out["recovery_base_lin_thr"] = str(self.lin_threshold)
        return out
