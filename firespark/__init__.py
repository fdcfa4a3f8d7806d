"""Spatio-temporal DataFrame operators for satellite fire detections."""
