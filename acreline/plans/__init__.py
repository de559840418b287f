"""acreline.plans"""
