"""acreline.operators"""
