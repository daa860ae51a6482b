"""Layers and detectors as data: what is searched for, what a section then says.

A detector is a list of probes.  A probe yields evidence, and a label if it has one; labels of probes
with evidence, in probe order, make the usual summary.  Detectors marked ``structured`` get their
evidence from the parsers of :mod:`sieveworks.plans.structured`.
"""

from __future__ import annotations

from dataclasses import dataclass

KT, GRADLE, TOML = "**/*.kt", "**/*.gradle*", "gradle/libs.versions.toml"
SCRIPTS = ("**/build.gradle.kts", "**/build.gradle")
BOTH_GRADLE = ("**/*.gradle", "**/*.gradle.kts")
YML = ("**/*.yml", "**/*.yaml")
UI = ("**/androidTest/**/*.kt", "**/androidTest/**/*.java")
UNIT = ("**/test/**/*.kt", "**/test/**/*.java")
SETTINGS = ("settings.gradle.kts", "settings.gradle")


@dataclass(frozen=True)
class Probe:
    """``kind``: ``lines``, ``whole`` (a pattern over whole files), ``files``, ``gate`` (substrings of a file)."""

    kind: str
    globs: tuple[str, ...]
    pattern: str = ""
    label: str = ""
    tier: int = 0
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    any_of: bool = False
    lower: bool = False
    snippet: str = ""
    case_sensitive: bool = False


def lines(pattern: str, *globs: str, label: str = "", tier: int = 0, case_sensitive: bool = False) -> Probe:
    return Probe("lines", globs, pattern, label, tier, case_sensitive=case_sensitive)


def whole(pattern: str, *globs: str, label: str = "") -> Probe:
    return Probe("whole", globs, pattern, label)


def files(*globs: str, label: str = "", snippet: str = "") -> Probe:
    return Probe("files", globs, label=label, snippet=snippet)


def gate(label: str, *has: str, lacks: tuple[str, ...] = (), any_of: bool = False, path: str = TOML) -> Probe:
    return Probe("gate", (path,), label=label, has=has, lacks=lacks, any_of=any_of, lower=True)


def falling_back(pattern: str, label: str, *tiers: tuple[str, ...]) -> list[Probe]:
    """The pattern in the first group of globs where anything matches."""
    return [lines(pattern, *globs, label=label, tier=i) for i, globs in enumerate(tiers)]


@dataclass(frozen=True)
class Detector:
    """``decides``: detected by ``evidence`` or by ``labels``; ``summary`` may hold {labels}, {sorted}, {n}."""

    id: str
    layer: str
    title: str
    keywords: str
    probes: tuple[Probe, ...] = ()
    summary: str = "{labels}"
    missing: str = ""
    decides: str = "evidence"
    kind: str = "signal"
    structured: bool = False


# Layers, sections, search words, patterns, globs, labels and summary texts.
LAYERS = {
    "01_overview": "Project Overview",
    "02_build_and_run": "Build and Run",
    "03_architecture": "Architecture",
    "04_modules_map": "Modules Map",
    "05_config_and_env": "Config and Environment",
    "06_dependencies": "Dependencies",
    "07_testing": "Testing",
    "08_ui_testing": "UI Testing",
    "09_ci_cd": "CI/CD",
}

HIGHLIGHTS = [
    ("identity", "01_overview", "repository_identity"),
    ("ui", "01_overview", "ui_technology_signals"),
    ("variants", "02_build_and_run", "build_types_flavors_dimensions"),
    ("di", "03_architecture", "di_framework"),
    ("networking", "03_architecture", "networking_stack"),
    ("persistence", "03_architecture", "persistence"),
    ("navigation", "03_architecture", "navigation"),
    ("modules", "04_modules_map", "full_module_list"),
    ("unit_testing", "07_testing", "non_ui_test_frameworks"),
    ("test_runner", "07_testing", "instrumentation_runner"),
    ("ui_testing", "08_ui_testing", "kaspresso_framework"),
    ("ci", "09_ci_cd", "ci_entrypoints"),
]


def _d(layer: str):
    def make(id: str, title: str, keywords: str, *probes, **more) -> Detector:
        flat = tuple(x for p in probes for x in (p if isinstance(p, list) else [p]))
        return Detector(id, layer, title, keywords, flat, **more)

    return make


_o, _b, _a, _m, _c, _p, _t, _u, _i = map(_d, LAYERS)
_MARKETING = r"onesignal|braze|appsflyer|adjust|firebase\.messaging|inapp|campaign|engagement"
_INJECTION = (lines("buildConfigField", GRADLE, label="buildConfigField"), lines("resValue", GRADLE, label="resValue"), lines("manifestPlaceholders", GRADLE, label="manifestPlaceholders"))
_INJECTION_WORDS = "buildConfigField resValue manifestPlaceholders config injection BuildConfig"

DETECTORS: list[Detector] = [
    _o("repository_identity", "Repository Identity", "root project name settings.gradle rootProject", structured=True, missing="settings.gradle not found"),
    _o("brands_flavors_presence", "Brands / Flavors Presence", "brand white label flavor flavour dimension applicationIdSuffix variant", lines(r"productFlavors\s*\{", *SCRIPTS, label="productFlavors"), lines("flavorDimensions", *SCRIPTS, label="flavorDimensions"), lines("applicationIdSuffix", *SCRIPTS, label="applicationIdSuffix"), lines("resConfigs", *SCRIPTS, label="resConfigs"), structured=True, missing="No flavors or brands detected"),
    _o("high_level_layout", "High-Level Layout", "layout structure directories top level folders", structured=True, missing="No top-level directories found"),
    _o("ui_technology_signals", "UI Technology Signals", "compose jetpack compose xml layout view ui toolkit composable", lines("compose", TOML, label="Compose deps"), lines("@Composable", KT, label="@Composable usage"), files("**/res/layout/*.xml", label="XML layouts"), missing="No UI technology signals found"),
    _o("external_systems", "External Systems", "integration vendor third party sdk push analytics auth provider", *[falling_back(p, n, (GRADLE,), (KT,)) for n, p in (("Content platform", "kontent|kentico|contentful"), ("Marketing/Engagement", _MARKETING), ("Analytics/Crash", "firebase.*analytics|crashlytics|sentry|appcenter|bugsnag"), ("Auth", "oauth|openid|appauth|auth0|jwt"))], summary="{sorted}", missing="No external system signals found"),
    _o("documentation_locations", "Documentation Locations", "docs readme contributing adr documentation", files("**/README*"), files("**/CONTRIBUTING*"), files("**/docs/**/*"), files("**/adr/**/*"), summary="{n} documentation locations", missing="No documentation locations found"),
    _b("gradle_entry_structure", "Gradle Entry Structure", "gradle settings pluginManagement wrapper build script entry point", files(*SETTINGS), lines(r"pluginManagement\s*\{", *SETTINGS), lines("includeBuild", *SETTINGS), files("buildSrc/**/*"), summary="Gradle build structure", missing="No Gradle structure found"),
    _b("module_types", "Module Types", "module type application library plugin com.android.application", structured=True, missing="No module types detected"),
    _b("build_types_flavors_dimensions", "Build Types / Flavors / Dimensions", "build type debug release flavor dimension variant", structured=True, missing="No build types/flavors found"),
    _b("config_injection_mechanisms", "Config Injection Mechanisms", _INJECTION_WORDS, *_INJECTION, missing="No config injection mechanisms found"),
    _b("version_sources", "Version Sources", "version catalog libs.versions.toml buildSrc gradle.properties", files(TOML, label="Version Catalog (libs.versions.toml)"), files("buildSrc/**/*.kt", label="buildSrc"), missing="No version sources found"),
    _b("custom_gradle_logic", "Custom Gradle Logic", "convention plugin build-logic buildSrc task custom gradle", files("**/convention/**/*.gradle.kts"), files("**/convention/**/*.kt"), lines(r"tasks\.register", GRADLE), files("**/gradle/*.gradle"), files("**/gradle/*.gradle.kts"), summary="{n} custom gradle configurations", missing="No custom Gradle logic found"),
    _b("code_resource_generation", "Code/Resource Generation", "kapt ksp annotation processor codegen generate", *[lines(p, GRADLE) for p in (r"tasks\.register.*[Gg]enerate", r"tasks\.register.*[Dd]ownload", r"tasks\.register.*[Ss]ync", "kapt", "ksp")], summary="Code generation tasks", missing="No code generation found"),
    _b("build_time_integrations", "Build-time Integrations", "minify proguard r8 shrink packaging kotlinOptions", *[lines(p, GRADLE, label=n) for p, n in (("minifyEnabled", "R8/Proguard"), ("proguardFiles", "Proguard rules"), ("shrinkResources", "Resource shrinker"), ("dexguard|DexGuard", "DexGuard"), ("composeOptions", "Compose compiler options"), (r"compose\s*=\s*true", "Compose buildFeatures"), ("kotlinOptions", "Kotlin options"), ("packagingOptions", "Packaging options"))], missing="No build-time integrations found"),
    _b("quality_gates_config", "Quality Gates Config", "lint detekt ktlint spotless quality gate static analysis", *[lines(p, GRADLE, label=n) for p, n in ((r"lintOptions|lint\s*\{", "Android Lint"), ("detekt", "Detekt"), ("ktlint", "Ktlint"), ("spotless", "Spotless"))], missing="No quality gates found"),
    _a("layering_hints", "Layering Hints", "layering grouping architecture modules feature core", structured=True, missing="settings.gradle not found"),
    _a("di_framework", "DI Framework", "di dependency injection hilt dagger koin module inject component", gate("Hilt", "hilt"), gate("Dagger 2", "dagger", lacks=("hilt",)), gate("Koin", "koin"), lines("hilt", TOML), lines("@(Component|Module|Inject|Provides|HiltAndroidApp|InstallIn)", KT), decides="labels", missing="No DI framework detected"),
    _a("networking_stack", "Networking Stack", "network http retrofit okhttp ktor interceptor api rest", gate("Retrofit", "retrofit"), gate("OkHttp", "okhttp"), gate("Ktor", "ktor"), lines("Interceptor|addInterceptor|addNetworkInterceptor", KT), lines(r"@(GET|POST|PUT|DELETE|PATCH|HTTP)\s*\(", KT), decides="labels", missing="No networking stack detected"),
    _a("persistence", "Persistence", "persistence database room datastore sharedpreferences cache storage", gate("Room", "room"), gate("DataStore", "datastore"), lines(r"import\s+androidx\.room", KT, label="Room"), lines("@(Entity|Dao|Database|Insert|Update|Delete)", KT, case_sensitive=True), lines("SharedPreferences|getSharedPreferences|PreferenceManager", KT, label="SharedPreferences"), decides="labels", missing="No persistence mechanism detected"),
    _a("navigation", "Navigation", "navigation navhost navcontroller deeplink graph route", gate("Jetpack Navigation", "navigation"), lines(r"NavHost|NavController|navController|navigate\s*\(", KT), lines("deepLink|DeepLink|uriPattern", KT, label="Deep Links"), files("**/navigation/*.xml", label="Navigation XML graphs", snippet="Navigation graph file"), decides="labels", missing="No navigation mechanism detected"),
    _a("state_management", "State Management", "state stateflow livedata uistate mvi mvvm viewmodel", lines("StateFlow|MutableStateFlow|stateIn", KT, label="StateFlow"), lines("LiveData|MutableLiveData|observeAsState", KT, label="LiveData"), lines("UiState|ViewState|ScreenState", KT, label="UiState pattern"), missing="No state management pattern detected"),
    _a("concurrency", "Concurrency", "concurrency coroutines dispatcher flow async suspend thread", lines(r"suspend\s+fun|CoroutineScope|viewModelScope|lifecycleScope", KT, label="Coroutines"), lines(r"Dispatchers\.(IO|Main|Default)|CoroutineDispatcher", KT, label="Dispatcher injection"), lines(r"\.collect\s*\{|\.collectLatest|flowOf|channelFlow", KT, label="Flow"), missing="No concurrency pattern detected"),
    _a("auth_session", "Auth/Session", "auth login token refresh oauth session authorization jwt", lines("accessToken|refreshToken|bearerToken|Authorization", KT, label="Token-based auth"), lines("OAuth|AppAuth|openid|PKCE", KT, label="OAuth/OpenID"), lines("SessionManager|UserSession|isLoggedIn|logout", KT, label="Session management"), missing="No auth mechanism detected"),
    _a("content_platform_integration", "Content Platform Integration", "cms content headless kontent contentful", falling_back("kontent|kentico|contentful", "", (GRADLE,), (KT,)), summary="Content platform signals", missing="No content platform signals found"),
    _a("marketing_engagement", "Marketing/Engagement", "marketing push campaign attribution engagement notification", falling_back(_MARKETING + "|push", "", (GRADLE,), (KT,)), summary="Marketing/engagement signals", missing="No marketing/engagement signals found"),
    _a("analytics_crash", "Analytics/Crash", "analytics crash crashlytics sentry tracking telemetry", gate("Firebase Analytics", "firebase", "analytics"), gate("Crashlytics", "crashlytics"), gate("Sentry", "sentry"), gate("AppCenter", "appcenter"), lines(r"FirebaseAnalytics|logEvent|trackEvent|Analytics\.", KT), decides="labels", missing="No analytics/crash service detected"),
    _a("feature_flags", "Feature Flags", "feature flag toggle remote config experiment rollout", gate("Firebase Remote Config", "remoteconfig", "remote-config", any_of=True), lines("featureFlag|FeatureToggle|isFeatureEnabled|RemoteConfig", KT, label="Feature flags"), decides="labels", missing="No feature flags detected"),
    _m("full_module_list", "Full Module List", "modules include settings.gradle module list subproject", structured=True, missing="settings.gradle not found"),
    _m("module_classification", "Module Classification", "module classification application library type", structured=True, missing="No module classification found"),
    _m("module_dependency_graph", "Module Dependency Graph", "dependency graph module dependencies project() projects. edges", structured=True, missing="No inter-module dependencies found"),
    _m("module_grouping", "Module Grouping", "grouping namespace feature core structure", structured=True, missing="settings.gradle not found"),
    _m("flavor_overrides_location", "Flavor Overrides Location", "flavor source set override src variant sources", structured=True, missing="No flavor override directories found"),
    _m("ui_tests_location_per_module", "UI Tests Location per Module", "androidTest instrumentation ui tests location module", structured=True, missing="No UI test locations found"),
    _m("test_fakes_stubs_modules", "Test Fakes/Stubs Modules", "fake stub mock test double fixtures", structured=True, missing="No test fakes/stubs found"),
    _c("config_sources_inventory", "Config Sources Inventory", "config properties json yaml settings environment", structured=True, missing="No config sources found"),
    _c("config_injection", "Config Injection", _INJECTION_WORDS, *_INJECTION, missing="No config injection mechanisms found"),
    _c("environment_mapping", "Environment Mapping", "environment base url endpoint staging production dev", lines("BASE_URL|baseUrl", KT, label="Base URLs"), lines(r"https?://[a-zA-Z0-9.-]+\.(dev|staging|prod)", KT, label="Environment URLs"), lines("environment|Environment", KT, label="Environment config"), files("**/BaseUrls*.kt"), summary="{labels}|Environment configuration", missing="No environment mapping found"),
    _c("secrets_handling", "Secrets Handling", "secret keystore gitignore credentials signing properties", *[Probe("gate", (".gitignore",), has=(x,), snippet=f"Ignored: {x}") for x in ("*.keystore", "*.jks", "secrets", "local.properties", "google-services.json")], files("**/*.example"), files("**/*.sample"), summary="Secrets protection configured", missing="No secrets handling found"),
    _c("feature_flags_remote_config_knobs", "Feature Flags / Remote Config Knobs", "feature flag toggle remote config knob experiment", lines("featureFlag|FeatureFlag|featureToggle|FeatureToggle|RemoteConfig|remoteConfig|experimentId|experimentFlag|abTest|ABTest", KT), *[lines("feature[_-]?flag|feature[_-]?toggle|remote[_-]?config|experiment", where + ext) for where in ("**/config*", "**/src/**/*") for ext in (".json", ".yml", ".yaml", ".properties", ".xml")], summary="Feature flags/remote config signals", missing="No feature flag config found"),
    _c("marketing_engagement_toggles", "Marketing/Engagement Toggles", "marketing toggle push enable campaign opt in consent", lines("(push|inapp|campaign|engagement|attribution).*(enable|disable|toggle)", KT), summary="Marketing/engagement toggles", missing="No marketing/engagement toggles found"),
    _c("analytics_crash_toggles", "Analytics/Crash Toggles", "analytics toggle crash collection opt out tracking consent", lines("(analytics|crashlytics|crash).*(enable|disable|collection|isEnabled)", KT), summary="Analytics/crash toggles", missing="No analytics/crash toggles found"),
    _c("debug_tooling_toggles", "Debug Tooling Toggles", "debug chucker stetho flipper leakcanary dev tools", *[falling_back(p, n, (GRADLE,), (KT,)) for p, n in (("chucker|Chucker", "Chucker"), ("stetho|Stetho", "Stetho"), ("flipper|Flipper", "Flipper"), ("leakcanary|LeakCanary", "LeakCanary"), ("hyperion|Hyperion", "Hyperion"))], files("**/src/debug/**/*.kt"), summary="{labels}|Debug tooling", missing="No debug tooling found"),
    _p("versions_source_of_truth", "Versions Source-of-Truth", "version catalog libs.versions.toml versions dependency versions bom", structured=True, missing="No version catalog found"),
    _p("core_stacks_inventory", "Core Stacks Inventory", "dependencies libraries stack inventory catalog", structured=True, missing="No version catalog to inventory"),
    _p("compose_setup", "Compose Setup", "compose composable compose compiler bom material3", lines("compose", TOML), lines("composeOptions|composeCompiler", GRADLE), lines("@Composable", KT), summary="Jetpack Compose", missing="No Compose setup found"),
    _p("quality_tooling", "Quality Tooling", "detekt ktlint spotless jacoco lint sonar coverage", *[x for n, p, g in (("Detekt", r"io\.gitlab\.arturbosch\.detekt|\bdetekt\b", "**/detekt*.yml"), ("Ktlint", r"org\.jlleitschuh\.gradle\.ktlint|\bktlint\b", ".editorconfig"), ("Spotless", r"com\.diffplug\.spotless|\bspotless\b", ""), ("JaCoCo", r"\bjacoco\b", ""), ("Android Lint", r"lintOptions|\blint\s*\{", "**/lint.xml"), ("SonarQube", r"org\.sonarqube|sonar\.projectKey", "sonar-project.properties")) for x in [lines(p, *BOTH_GRADLE, TOML, label=n), *([files(g, label=n, snippet=f"{n} configuration")] if g else [])]], missing="No quality tooling found"),
    _t("test_source_sets_map", "Test Source Sets Map", "test source set src/test androidTest unit tests modules", structured=True, missing="No test source sets found"),
    _t("non_ui_test_frameworks", "Non-UI Test Frameworks", "junit mockk mockito kotest truth turbine unit test", *[falling_back(p, n, (GRADLE,), ("**/src/test/**/*.kt",)) for p, n in ((r"org\.junit", "JUnit"), (r"io\.kotest", "Kotest"), (r"io\.mockk", "MockK"), (r"org\.mockito", "Mockito"), (r"com\.google\.truth", "Truth"), (r"org\.assertj", "AssertJ"), (r"kotlinx\.coroutines\.test", "Coroutines Test"))], missing="No test frameworks found"),
    _t("shared_fixtures_builders", "Shared Fixtures/Builders", "fixture builder test data helper shared", *[Probe("dirs", (name,), snippet="Test fixtures") for name in ("fixtures", "testdata", "builders", "testfixtures", "testcommon")], lines(r"class\s+\w+Builder", "**/test/**/*.kt"), lines(r"object\s+\w+Factory|fun\s+create\w+", "**/test/**/*.kt"), summary="{n} fixtures/builders found", missing="No shared fixtures found"),
    _t("test_resources", "Test Resources", "test resources json fixtures assets stub data", files("**/src/test/resources/**/*"), files("**/test/**/*.json"), summary="{n} test resources", missing="No test resources found"),
    _t("test_config_knobs", "Test Config Knobs", "testInstrumentationRunner testOptions orchestrator test configuration animations", lines("testInstrumentationRunner", GRADLE), lines("testOptions", GRADLE), files("**/test*.properties"), summary="Test configuration", missing="No test config knobs found"),
    _t("repo_docs_about_testing", "Repo Docs About Testing", "testing docs readme how to test documentation", Probe("gate", ("**/README*",), has=("test",), lower=True, snippet="Testing docs"), files("**/CONTRIBUTING*"), summary="{n} test documentation files", missing="No test documentation found"),
    _t("instrumentation_runner", "Instrumentation Runner", "runner testInstrumentationRunner AndroidJUnitRunner orchestrator HiltTestApplication how to run tests", lines(r"""testInstrumentationRunner\s*[=\s]\s*['"]([^'"]+)['"]""", *BOTH_GRADLE, label="runner"), lines(r"class\s+(\w+)\s*:\s*AndroidJUnitRunner|extends\s+AndroidJUnitRunner", *UI, label="custom runner class"), lines(r"newApplication\s*\(|HiltTestApplication|TestApplication::class", *UI, label="test Application override"), lines(r"ANDROIDX_TEST_ORCHESTRATOR|androidx_test_orchestrator|clearPackageData|androidx\.test:orchestrator", *BOTH_GRADLE, TOML, label="Android Test Orchestrator"), structured=True, missing="No instrumentation runner observed"),
    _t("test_tasks", "Test Tasks", "gradle task connectedAndroidTest testDebugUnitTest managed devices run tests command", structured=True, missing="No test tasks referenced in the repository"),
    _t("test_dependency_substitution", "Test Dependency Substitution", "TestInstallIn BindValue UninstallModules fake mockwebserver wiremock stub", *[lines(p, *UI, *UNIT, label=n) for n, p in (("Hilt test modules", "@TestInstallIn|@UninstallModules|@BindValue"), ("Hilt test entry point", "@HiltAndroidTest|HiltAndroidRule"), ("MockWebServer", "MockWebServer|mockwebserver"), ("WireMock", "WireMockServer|wiremock"), ("Fake implementations", r"\b(class|object)\s+Fake\w+"), ("Test doubles module", r"@Module[\s\S]{0,80}Test|TestAppModule|TestNetworkModule"), ("Robolectric", r"@RunWith\s*\(\s*RobolectricTestRunner|robolectric"))], summary="Observed: {labels}", missing="No test dependency substitution observed"),
    _t("test_entry_points", "Test Entry Points", "base test TestCase rule TestWatcher robot helper start here", lines(r"\b(abstract\s+class|open\s+class)\s+(Base\w*Test\w*|\w*TestCase)\b", *UI, *UNIT, label="{k} base test classes"), lines(r"\bclass\s+\w+Rule\b|:\s*TestWatcher\b|implements\s+TestRule", *UI, *UNIT, label="{k} custom JUnit rules"), files(*[f"**/androidTest/**/*{x}.{e}" for x in ("Robot", "Screen", "Helper*", "Util*") for e in ("kt", "java")], "**/test/**/*Helper*.kt", "**/test/**/*Helper*.java", label="{k} screen/robot/helper files", snippet="test helper"), summary="Observed: {parts}", missing="No shared test entry points observed"),
    _u("ui_test_framework_location", "UI Test Framework Location", "androidTest ui tests package location instrumentation", structured=True, missing="No UI test locations found"),
    _u("screen_objects_inventory", "Screen Objects Inventory", "screen object page object robot kakao screen", files("**/androidTest/**/*Screen.kt", "**/androidTest/**/*Screen.java"), summary="Found {n} Screen/Robot/Page objects", missing="No Screen objects found"),
    _u("screen_names_inventory", "Screen Names Inventory", "screen names screens page objects inventory", lines(r"\b(class|object)\s+([A-Za-z0-9_]+Screen)\b", *UI, case_sensitive=True), structured=True, missing="No Screen class names found"),
    _u("ui_test_class_names", "UI Test Class Names", "test classes ui tests test names androidTest", lines(r"\bclass\s+([A-Za-z0-9_]+Test)\b", *UI, case_sensitive=True), structured=True, missing="No UI test class names found"),
    _u("ui_test_application_class", "UI Test Application Class", "test application HiltTestApplication runner newApplication test di", structured=True, missing="No test application class signals found"),
    _u("scenarios_directory", "Scenarios Directory", "scenario kaspresso steps flows directory", structured=True, missing="No scenarios directories found"),
    _u("compose_selectors_convention", "Compose Selectors Convention", "testTag semantics compose test selector contentDescription", lines(r"\.semantics\s*\{\s*testTag\s*=", KT), lines(r"Modifier\.testTag\s*\(", KT), summary="Found {n} testTag usages", missing="No Compose testTag selectors found"),
    _u("kaspresso_framework", "Kaspresso Framework", "kaspresso kakao espresso ui test framework TestCase", lines("kaspresso", TOML), lines(r"import\s+com\.kaspersky\.kaspresso", *UI), lines(r":\s*TestCase[<(]|TestCaseRule", *UI), summary="Kaspresso test framework", missing="Kaspresso not detected"),
    _u("step_dsl_helpers", "Step DSL / Helpers", "step flakySafely dsl scenario kaspresso", lines(r"""\bstep\s*\(\s*["']""", *UI, label="step DSL"), lines(r"flakySafely\s*\{|flakySafely\s*\(", *UI, label="flakySafely"), lines(r"Scenario\s*\(|scenario\s*\{", *UI, label="Scenario"), missing="No Step DSL detected"),
    _u("synchronization_utilities", "Synchronization Utilities", "idling resource wait synchronization timeout flaky await", lines("IdlingResource|CountingIdlingResource|IdlingRegistry", *UI), lines("waitFor|waitUntil|awaitIdle|idleSync|waitForIdle", *UI), lines("timeout|retry", *UI), summary="Synchronization helpers", missing="No synchronization utilities detected"),
    _u("determinism_hooks", "Determinism Hooks", "mockwebserver wiremock fake TestInstallIn determinism stub", lines(r"Test\w*Component|@TestInstallIn|TestAppComponent", *UI, label="Test DI Component"), lines(r"class\s+Fake\w+|class\s+Mock\w+|object\s+Fake\w+", *UI, label="Fake implementations"), lines("MockWebServer|WireMock|mockServer", *UI, label="Mock server"), missing="No determinism hooks detected"),
    _u("login_auth_helpers", "Login/Auth Helpers", "login helper auth token injection test user session", lines(r"fun\s+login|\b(?:void|\w+)\s+login\s*\(|loginAs|performLogin|authenticateUser", *UI, label="Login helpers"), lines("injectToken|setTestToken|mockToken", *UI, label="Token injection"), lines("TestUser|testCredentials|test_users", *UI, label="Test users config"), missing="No login/auth helpers detected"),
    _u("deep_links_webview_helpers", "Deep Links / WebView Helpers", "deep link webview intent uri helper", lines(r"deepLink|DeepLink|Intent\.ACTION_VIEW|Uri\.parse", *UI), lines("WebView|WebViewClient|webkit", *UI), summary="Deep links/WebView helpers", missing="No deep link or WebView helpers detected"),
    _u("ui_suite_grouping", "UI Suite Grouping", "suite smoke regression tag annotation grouping", lines("@(Smoke|Sanity|Regression|Quarantine|FlavorFilter)", *UI, label="Custom annotations"), lines(r"""@Tag\s*\(\s*["']""", *UI, label="JUnit @Tag"), lines(r"@Suite|@RunWith\(Suite", *UI, label="JUnit Suite"), missing="No suite grouping detected"),
    _u("reporting_hooks", "Reporting Hooks", "allure report screenshot artifact watcher", lines(r"@(Step|Attachment|Epic|Feature|Story)|Allure\.", *UI, label="Allure"), lines("Screenshot|takeScreenshot|captureScreen", *UI, label="Screenshot capture"), lines("TestWatcher|TestListener|RunListener", *UI, label="Test listeners"), missing="No reporting hooks detected"),
    _u("deep_link_inventory", "Deep Link Inventory", "deep link intent filter scheme host uri entry point", kind="inventory", structured=True, missing="No deep links found"),
    _u("exported_components", "Exported Components", "exported activity service receiver provider launch manifest", kind="inventory", structured=True, missing="No exported components found"),
    _u("test_tag_inventory", "Test Tag Inventory", "testTag android:id selector compose resource id locator", kind="inventory", structured=True, missing="No test tags found"),
    _i("ci_entrypoints", "CI Entrypoints", "ci gitlab github actions jenkins pipeline workflow", files(".gitlab-ci.yml", label="x", snippet="GitLab CI main config"), lines(r"^\s*-?\s*(local|project|remote|template):\s*", ".gitlab-ci.yml"), *[files(f, label="x", snippet=s) for f, s in (("Jenkinsfile", "Jenkins pipeline"), ("bitrise.yml", "Bitrise config"), ("azure-pipelines.yml", "Azure Pipelines config"), (".circleci/config.yml", "CircleCI config"))], files("ci/**/*.yml", "ci/**/*.yaml", ".gitlab/**/*.yml", ".gitlab/**/*.yaml", ".github/workflows/*.yml", ".github/workflows/*.yaml", label="x", snippet="CI config file"), summary="Found {labelled} CI config files", missing="No CI configuration found"),
    _i("jobs_and_stages", "Jobs & Stages", "stages jobs pipeline ci workflow", structured=True, missing="No jobs/stages found"),
    _i("scheduled_nightly_signals", "Scheduled/Nightly Signals", "schedule nightly cron trigger pipeline source", lines(r"""CI_PIPELINE_SOURCE\s*==\s*["']schedule["']|schedules|nightly""", *YML), summary="Found {n} schedule-related rules", missing="No scheduled signals found"),
    _i("marathon_integration", "Marathon Integration", "marathon test runner sharding device farm", files("Marathonfile", "marathonfile.yaml", "marathon.yaml", label="Marathonfile", snippet="Marathon configuration file"), lines("pool|batch|retry|output", "Marathonfile", "marathonfile.yaml", "marathon.yaml"), lines(r"marathon\s+(-|run|--)", *YML, label="Marathon commands"), files("**/marathonfilegen*.kts", "**/marathon/**/*.kts", label="Marathon generator"), missing="No Marathon integration found"),
    _i("variables_controlling_runs", "Variables Controlling Runs", "variable suite flavor emulator count shard retry parameter", *[lines(p, *YML) for p in (r"\$SUITE|\$\{SUITE\}|SUITE:", r"\$FLAVOR|\$\{FLAVOR\}|FLAVOR:", r"\$EMULATOR_COUNT|\$\{EMULATOR_COUNT\}", r"\$SHARD|\$\{SHARD\}|shards?:", r"\$RETRY|\$\{RETRY\}|retry:")], summary="Found {distinct} control variables", missing="No control variables found"),
    _i("emulator_device_provisioning", "Emulator/Device Provisioning", "emulator avd kvm runner device image", whole(r"tags:\s*\n\s*-\s*\w+|tags:\s*\[", *YML, label="Runner tags"), lines(r"image:\s*\S+emulator|image:\s*\S+android|docker.*emulator", *YML, label="Docker emulator images"), lines("kvm|KVM|/dev/kvm", *YML, label="KVM"), files("**/create_avd*", "**/start_emulator*", label="AVD scripts"), missing="No emulator provisioning found"),
    _i("artifacts_and_reports", "Artifacts & Reports", "artifacts junit allure report results", whole(r"artifacts:\s*\n|paths:\s*\n\s*-", *YML, label="artifacts"), whole(r"reports:\s*\n\s*junit:|junit:\s*", *YML, label="JUnit reports"), lines("allure|Allure|ALLURE", *YML, label="Allure"), lines(r"^\s*(?:(?:junit|path|outputDir)\s*:\s*|-\s+)(?:[^#\n]*)(?:build/|reports?|results?|screenshots?)[^#\n]*$", *YML, "Marathonfile"), decides="labels", structured=True, missing="No CI artifacts or reports observed"),
    _i("notifications", "Notifications", "notification teams slack webhook alert", *[lines(p, *YML, "**/*.sh", "Jenkinsfile", label=n) for n, p in (("Teams", r"teams\.microsoft\.com|outlook\.office\.com/webhook|office\.com/webhook|microsoft\s*teams|TEAMS_WEBHOOK"), ("Slack", r"hooks\.slack\.com|SLACK_WEBHOOK|slackSend|slack-notify"), ("Discord", r"discord\.com/api/webhooks|DISCORD_WEBHOOK"), ("Telegram", r"api\.telegram\.org|TELEGRAM_(BOT_)?TOKEN"), ("E-mail", r"^\s*email:|mailto:|send-?mail"), ("Generic webhook", "WEBHOOK_URL|webhook_url"))], missing="No notification hooks found"),
    _i("caching", "Caching", "cache gradle cache ci speed key policy", whole(r"cache:\s*\n|key:\s*|policy:\s*", *YML), lines(r"\.gradle|gradle-cache|GRADLE_USER_HOME", *YML), summary="Found {n} cache configurations", missing="No caching configuration found"),
    _i("retry_flakiness_handling", "Retry/Flakiness Handling", "retry flaky rerun stability strategy", whole(r"^\s*retry:\s*\d+|retry:\s*\n\s*max:", *YML, label="GitLab retry"), lines("retryStrategy|strictMode|flakyTests", "**/Marathonfile*", label="Marathon retry"), lines("retryStrategy|strictMode|flakyTests", "**/marathon*.yaml", label="Marathon retry"), missing="No retry/flakiness handling found"),
]


def catalogue() -> str:
    """The registry as Markdown: layers, then their sections with search words."""
    out = []
    for layer, title in LAYERS.items():
        out += [f"## {layer.split('_')[0]} {title}", ""]
        out += [f"- `{d.id}` **{d.title}** ({d.kind}): {d.keywords}" for d in DETECTORS if d.layer == layer] + [""]
    return "\n".join(out)
