"""The staging helpers under the name that queries use."""

from ..staging import remove, scratch_path, shared_dir, stage  # noqa: F401
