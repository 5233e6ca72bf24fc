"""Written tables that cut lineage; see ``fathomline.staging``."""

from fathomline.staging import Scratch, checkpoint_dir

__all__ = ["Scratch", "checkpoint_dir"]
