"""Small helpers."""


def format_duration(seconds: float) -> str:
    """ms below a second, seconds below a minute, then minutes and seconds."""
    if seconds < 1:
        return f"{seconds * 1000:.1f} ms"
    if seconds < 60:
        return f"{seconds:.2f} s"
    return f"{int(seconds // 60)} min {seconds % 60:.1f} s"
